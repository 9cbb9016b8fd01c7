from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    home = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.local.dir", str(home)).config("spark.checkpoint.dir", str(home / "shared")).config("spark.sql.warehouse.dir", str(home / "warehouse"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[1]))
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


def plain(rows, columns):
    """Rows as sorted tuples of comparable values."""

    def value(v):
        if isinstance(v, bool) or v is None:
            return v
        if isinstance(v, (int, float)):
            return None if v != v else round(float(v), 6)
        return str(v)

    return sorted((tuple(value(r[c]) for c in columns) for r in rows), key=repr)


def duckdb_rows(sql: str, sf_dir: str = SF):
    import duckdb

    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, [dict(zip(names, r, strict=True)) for r in out.fetchall()]


def assert_same(df, sql: str, sf_dir: str = SF) -> None:
    names, want = duckdb_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got = df.collect()
    assert plain(got, sorted(names)) == plain(want, sorted(names))
