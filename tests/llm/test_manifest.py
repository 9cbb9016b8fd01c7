from __future__ import annotations

import hashlib
import zlib

from fleetmatch.llm import manifest
from tests.llm.conftest import documents


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    chars = None if r["n_chars"] is None else r["n_chars"] + more
    return h(*[field(v) for v in (r["doc_id"], r["source"], r["lang"], chars, r["text"])])


def folded_tree(nodes):
    """Root of a list of digests, and the siblings (side, digest) of each from the bottom up."""
    ways, at, levels = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(levels) > 1:
        for k, i in enumerate(at):
            other = i ^ 1
            ways[k].append((i & 1, levels[other] if other < len(levels) else ""))
            at[k] = i // 2
        levels = [h(*levels[i : i + 2]) for i in range(0, len(levels), 2)]
    return (levels or [None])[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append(r)
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    out, subs = [], []
    for g in keys:
        mine = sorted(groups[g], key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        root, ways = folded_tree([leaf(r) for r in mine])
        subs.append(root)
        out.append((mine, root, ways))
    root, tops = folded_tree(subs)
    result = []
    for (mine, sub, ways), top in zip(out, tops, strict=True):
        for r, way in zip(mine, ways, strict=True):
            hit = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            acc = leaf(r, 1 if hit else 0)
            for side, sibling in way + top:
                acc = h(sibling, acc) if side else h(acc, sibling)
            result.append((r["doc_id"], leaf(r), sub, root, h(*[s for _, s in way + top]), acc, acc == root))
    return sorted(result, key=repr)


def got(df):
    return sorted([tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()], key=repr)


def test_against_plain_tree(spark):
    """Several segments, odd runs, groups of one, null and empty languages, null fields, repeated rows, long texts."""
    rows = [{"doc_id": i, "source": None if i % 5 == 0 else "é", "lang": ["en", None, "", "zz"][min(3, i % 9)], "n_chars": None if i % 11 == 0 else i, "text": None if i % 13 == 0 else "ß" * (i % 40)} for i in range(1500)]
    rows += [{"doc_id": 7, "source": "s", "lang": "only", "n_chars": 1, "text": "x" * 200_000}]
    rows += [{"doc_id": 90_000, "source": "s", "lang": "en", "n_chars": 1, "text": "copy"}] * 600  # whole segments are equal
    rows += [{"doc_id": None, "source": None, "lang": None, "n_chars": None, "text": None}] * 2
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert got(manifest.audited(df.repartition(7))) == plain(rows)


def test_single_row_and_empty_table(spark):
    df = spark.createDataFrame([(3, "s", "en", 2, "ab")], "doc_id long, source string, lang string, n_chars long, text string")
    [r] = manifest.audited(df).collect()
    assert (r.leaf, r.subroot, r.root, r.proof_sha256) == (r.leaf, r.leaf, r.leaf, h()) and r.verified
    assert manifest.audited(df.limit(0)).count() == 0


def test_clashing_names(spark, corpus):
    docs = documents(spark, corpus)
    more = docs.selectExpr("*", "1 as grp", "2 as rank", "3 as Digest", "4 as levels", "5 as segment", "6 as path")
    assert got(manifest.audited(more)) == got(manifest.audited(docs))


def test_proofs_of_some_rows(spark):
    """Requests for single rows, found or not; a changed row does not fold to the root, the row itself does."""
    rows = [("1en", i, h(str(i))) for i in range(777)]
    df = spark.createDataFrame(rows, "grp string, id long, digest string")
    made = manifest.manifest(df, ["id"])
    asked = spark.createDataFrame([("1en", i) for i in (0, 255, 256, 776, 777)], "grp string, rank long")
    out = manifest.proofs(made, asked)
    root, ways = folded_tree([r[2] for r in rows])
    seen = {r["rank"]: r for r in out.withColumn("back", manifest.folded(out["leaf"], out["path"])).collect()}
    assert sorted(seen) == [0, 255, 256, 776]
    for i, r in seen.items():
        assert r.leaf == rows[i][2] and r.root == r.back == root
        assert [(int(s.left), s.sibling or "") for s in r.path] == ways[i]
