"""Folds against sequential replay, checkpoints, inbox, outbox, codecs and matching."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetmatch.functions import codec
from fleetmatch.functions.spatial import Layout, with_cell
from fleetmatch.operators import batches as B
from fleetmatch.operators import checkpoints as K
from fleetmatch.operators import matching as M
from fleetmatch.operators import metrics as R
from fleetmatch.operators import outbox as X
from fleetmatch.operators import state as T
from fleetmatch.sources import event_log as L
from fleetmatch.streaming.streams import BLANK, ORDER_FIELDS, apply_event

EVENT = "event_id string, order_id long, shard_id int, offset_value long, event_type string, occurred_at long, x int, y int, attempt int, reason string, rider_id long, score int"
KINDS = ["order_created", "order_cancelled", "order_retry_request", "order_matched", "order_missed"]


def events(spark, *rows):
    full = [(f"e{i}", o, 0, i, k, 100 + i, 10 + i, 20 + i, i, f"r{i}", 80 + i, 90 + i) for i, (o, k) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def status(df):
    return {r["order_id"]: r["status"] for r in df.collect()}


def test_transitions(spark):
    rows = [(1, "order_created"), (2, "order_cancelled"), (3, "order_missed"), (3, "order_retry_request"), (4, "order_matched"), (5, "order_missed"), (6, "order_created"), (6, "order_cancelled"), (6, "order_matched"), (7, "order_retry_request")]
    got, bad = T.fold_order_state(events(spark, *rows))
    assert status(got) == {1: "created", 2: "cancelled", 3: "retry_requested", 4: "matched", 5: "missed", 6: "matched"}
    assert [r["error"] for r in bad.collect()] == ["retry before creation"]


def test_late_match_revives_a_cancelled_order_and_retry_reopens_it(spark):
    got, _ = T.fold_order_state_tx(events(spark, (1, "order_created"), (1, "order_cancelled"), (1, "order_retry_request")))
    row = got.first()
    assert (row["status"], row["attempt"], row["cancel_reason"]) == ("match_pending", 0, "r1")


def test_transactional_fold_is_the_sequential_one(spark):
    rng = random.Random(5)
    rows = [(o, rng.choice(KINDS)) for o in range(300) for _ in range(rng.randint(1, 7))]
    frame = events(spark, *rows)
    want = {}
    for e in sorted((r.asDict() for r in frame.collect()), key=lambda e: e["offset_value"]):
        order = want.setdefault(e["order_id"], {"first": e["event_type"], **dict(zip(ORDER_FIELDS, BLANK, strict=True))})
        apply_event(order, e)
    got, bad = T.fold_order_state_tx(frame)
    seen = {r["order_id"]: {f: r[f] for f in ORDER_FIELDS} for r in got.collect()}
    assert seen == {k: {f: v[f] for f in ORDER_FIELDS} for k, v in want.items() if v["first"] != "order_retry_request"}
    assert bad.count() == sum(want[o]["first"] == "order_retry_request" for o, _ in rows)


def test_rider_lifecycle(spark):
    rows = [(0, 1, "online", 1, 1), (1, 2, "move", 5, 5), (2, 3, "online", 1, 1), (3, 3, "move", 2, 2), (4, 3, "offline", 0, 0), (5, 3, "move", 9, 9)]
    frame = spark.createDataFrame(rows, "seq long, uid long, type string, x int, y int")
    assert [tuple(r) for r in T.fold_rider_lifecycle(frame).collect()] == [(1, 1, 1, True)]
    assert sorted(tuple(r) for r in T.fold_rider_lifecycle(frame, soft_delete=True).collect()) == [(1, 1, 1, True), (3, 2, 2, False)]


CP = "consumer_name string, topic string, shard_id int, offset_value long, epoch long, node_id int, updated_at long"


def test_checkpoint_guards(spark):
    stored = spark.createDataFrame([("c", "t", 1, 10, 5, 1, 0)], CP)
    cases = {(9, 5): "stale", (10, 4): "stale", (11, 5): None, (-1, 5): "invalid", (11, 0): "invalid"}
    for (offset, epoch), error in cases.items():
        saved, bad = K.save_checkpoints_strict(stored, spark.createDataFrame([("c", "t", 1, offset, epoch, 1, 1)], CP))
        assert [r["error"] for r in bad.collect()] == ([error] if error else [])
        assert saved.first()["offset_value"] == (10 if error else offset)
    loose = lambda offset, epoch: K.save_checkpoints(stored, spark.createDataFrame([("c", "t", 1, offset, epoch, 1, 1)], CP), "updated_at").first()["offset_value"]
    assert (loose(3, 5), loose(3, 4), loose(20, 6)) == (3, 10, 20)


def test_batches(spark):
    rows = spark.createDataFrame([(62, 1, "a", 62), (62, 3, "b", 62)], "shard_id int, offset_value long, event_id string, event_shard_id int")
    owned = spark.createDataFrame([(62,)], "shard_id int")
    assert [tuple(r) for r in B.validate_batches(rows, owned).collect()] == [(62, 3, "offset gap")]


def test_log_positions(spark):
    log = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "shard_id int, offset_value long, event_id string")
    cp = spark.createDataFrame([(1, 2)], "shard_id int, offset_value long")
    assert [r["event_id"] for r in L.read_from_positions(log, cp).collect()] == ["c"]
    shards = spark.createDataFrame([(1,), (2,)], "shard_id int")
    assert sorted(tuple(r) for r in L.end_offsets(log, shards).collect()) == [(1, 3), (2, 0)]
    new = spark.createDataFrame([(1, "x", 5), (2, "y", 6), (1, "z", 4)], "shard_id int, event_id string, seq long")
    assert sorted((r["event_id"], r["offset_value"]) for r in L.append_events(log, new, "seq").collect()) == [("x", 4), ("y", 0), ("z", 3)]


def test_codec_rejects(spark):
    raw = spark.createDataFrame([(1, 0, None), (1, 1, "nope"), (1, 2, '{"ID":"a","Type":""}'), (1, 3, '{"ID":"a","Type":"order_created","ShardID":9}')], "partition int, offset long, value string")
    good, bad = codec.decode_envelopes(raw)
    assert [(r["event_id"], r["shard_id"]) for r in good.collect()] == [("a", 1)]
    assert sorted(r["error"] for r in bad.collect()) == ["bad json", "empty type", "null value"]


def test_outbox(spark):
    schema = "event_id string, event_type string, aggregate_id string, occurred_at long, published_at long, topic string, claimed_by string, claimed_until long, attempts int, last_error string"
    box = spark.createDataFrame([(f"e{i}", "t", str(i), i, None if i < 6 else 1, "a", "", 0, 0, "") for i in range(8)], schema)
    claimed = X.claim_outbox_split(box, ["w1", "w2"], 100, n=10)
    assert claimed.count() == claimed.select("event_id").distinct().count() == 6
    mine = X.claim_outbox(box, "w1", 100, n=2)
    held = X.apply_claims(box, mine)
    done = X.mark_outbox_published(held, mine, "w1", 7)
    assert X.checked_updates(done, 2) == 2
    with pytest.raises(ValueError):
        X.checked_updates(X.mark_outbox_published(held, box, "w1", 7), 8)


@pytest.mark.parametrize("mode", ["exact", "rounds"])
def test_matching_invariants(spark, mode):
    rng = random.Random(3)
    lay = Layout(area=1000, cell=60, shards=9)
    orders = spark.createDataFrame([(i, rng.randrange(1000), rng.randrange(1000), i) for i in range(150)], "order_id long, x int, y int, seq long")
    riders = spark.createDataFrame([(i, rng.randrange(1000), rng.randrange(1000), i % 9 > 0, 0) for i in range(40)], "uid long, x int, y int, online boolean, count long")
    out = [M.match_orders(orders, riders, lay, mode=mode).collect() for _ in range(2)]
    assert sorted(map(repr, out[0])) == sorted(map(repr, out[1]))
    assert sorted(r["order_id"] for r in out[0]) == list(range(150))
    load = {}
    for r in out[0]:
        if r["rider_id"] is not None:
            load[r["rider_id"]] = load.get(r["rider_id"], 0) + 1
    assert max(load.values()) <= 3
    from fleetmatch.operators.candidates import tiered_candidate_join

    pools = {}
    for p in tiered_candidate_join(orders, riders.filter("online"), lay).collect():
        pools.setdefault(p["order_id"], set()).add(p["rider_id"])
    for r in out[0]:
        pool = pools.get(r["order_id"], set())
        assert r["rider_id"] in pool if r["rider_id"] is not None else all(load.get(u, 0) == 3 for u in pool)


def replayed(orders, riders, cap=3, k=10, weight=10_000, cell=60):
    """The sequential semantics on one shard: one order after the other, loads as they are by then."""
    load = {u: n for u, _, _, online, n in riders if online}
    place = {u: (x, y) for u, x, y, _, _ in riders}
    out = {}
    for i, x, y, _ in sorted(orders, key=lambda o: o[3]):
        at = lambda p: (p[0] // cell, p[1] // cell)
        far = {u: max(abs(at(place[u])[0] - x // cell), abs(at(place[u])[1] - y // cell)) for u in load}
        pool = next((own for low, high in ((-1, 1), (1, 3), (3, 8)) if (own := [u for u in load if low < far[u] <= high])), [])
        ranked = sorted(((abs(x - place[u][0]) + abs(y - place[u][1])) // cell + load[u] * weight, u) for u in pool)[:k]
        out[i] = next(((u, s) for s, u in ranked if load[u] < cap), (None, None))
        if out[i][0] is not None:
            load[out[i][0]] += 1
    return out


def test_matching_is_the_sequential_replay(spark):
    rng = random.Random(6)
    orders = [(i, rng.randrange(1000), rng.randrange(1000), 500 - i) for i in range(250)]
    riders = [(i, rng.randrange(1000), rng.randrange(1000), i % 7 > 0, i % 3) for i in range(45)]
    got = M.match_orders(spark.createDataFrame(orders, "order_id long, x int, y int, seq long"), spark.createDataFrame(riders, "uid long, x int, y int, online boolean, count long"), Layout(area=1000, cell=60, shards=1))
    assert {r["order_id"]: (r["rider_id"], r["score"]) for r in got.collect()} == replayed(orders, riders)


REQUEST = "event_id string, order_id long, x int, y int, shard_id int, offset_value long, occurred_at long"
ORDER = "order_id long, shard_id int, status string, x int, y int, attempt int, miss_reason string, rider_id long, score int"
INBOX = "consumer_name string, event_id string, shard_id int, offset_value long"
RIDER = "uid long, x int, y int, online boolean, count long"


def test_requests_are_matched_once(spark):
    lay = Layout(area=100, cell=10, shards=1)
    orders = spark.createDataFrame([(i, 0, s, 1, 1, 0, "", 0, 0) for i, s in ((1, "match_pending"), (2, "matched"), (3, "match_pending"), (4, "match_pending"), (5, "cancelled"))], ORDER)
    riders = spark.createDataFrame([(1, 2, 2, True, 2)], RIDER)
    inbox = spark.createDataFrame([("matcher-worker", "old", 0, 0), ("someone", "e1", 0, 0)], INBOX)
    rows = [("e1", 1, 1, 1, 0, 1, 10), ("e1", 1, 1, 1, 0, 2, 10), ("e2", 2, 1, 1, 0, 3, 11), ("old", 3, 1, 1, 0, 4, 12), ("e4", 4, 1, 1, 0, 5, 13), ("e5", 5, 1, 1, 0, 6, 14), ("e6", 1, 1, 1, 0, 7, 15)]
    done = M.apply_requests(spark.createDataFrame(rows, REQUEST), orders, riders, inbox, lay)
    assert sorted(tuple(r) for r in done.outcomes.select("event_id", "order_id", "rider_id").collect()) == [("e1", 1, 1), ("e4", 4, None)]
    assert sorted(tuple(r) for r in done.skipped.collect()) == [("e1", 1, "seen"), ("e2", 2, "not pending"), ("e5", 5, "not pending"), ("e6", 1, "not pending"), ("old", 3, "seen")]
    assert status(done.orders) == {1: "matched", 2: "matched", 3: "match_pending", 4: "missed", 5: "cancelled"}
    assert done.riders.first()["count"] == 3
    assert done.inbox.filter("consumer_name = 'matcher-worker'").count() == 6
    again = M.apply_requests(spark.createDataFrame(rows[:1], REQUEST), done.orders, done.riders, done.inbox, lay)
    assert again.outcomes.count() == 0 and again.riders.first()["count"] == 3
    results = {r["event_id"] for r in codec.build_result_events(done.outcomes).collect()}
    assert results == {"e1-order_matched", "e4-order_missed"}
    with pytest.raises(ValueError, match="not found"):
        M.apply_requests(spark.createDataFrame([("e9", 9, 1, 1, 0, 9, 20)], REQUEST), orders, riders, inbox, lay)


def test_missed_orders_are_retried_through_the_log(spark):
    orders = spark.createDataFrame([(i, 1, 1, i) for i in range(1, 6)], "order_id long, x int, y int, seq long")
    riders = spark.createDataFrame([(1, 2, 2, True, 0)], RIDER)
    got = M.retry_missed(orders, riders, Layout(area=100, cell=10, shards=1), 2)
    assert sorted((r["order_id"], r["status"], r["attempt"]) for r in got.collect()) == [(1, "matched", 0), (2, "matched", 0), (3, "matched", 0), (4, "missed", 2), (5, "missed", 2)]


def test_places_and_predecessors_across_ranges(spark):
    from fleetmatch.operators.ranks import with_place, with_previous

    rng = random.Random(2)
    rows = [(g, v) for g in ("a", None, "b") for v in rng.sample(range(5000), {"a": 400, "b": 3}.get(g, 60))]
    frame = spark.createDataFrame(rows, "g string, v long")
    for parts in (2, 40):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = with_previous(with_place(frame, ["g"], "v", "place"), ["g"], "v", "before").collect()
        for g in ("a", None, "b"):
            own = sorted(v for h, v in rows if h == g)
            want = [(v, k + 1, own[k - 1] if k else None) for k, v in enumerate(own)]
            assert sorted((r["v"], r["place"], r["before"]) for r in got if r["g"] == g) == want
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert with_place(frame.limit(0), ["g"], "v", "place").count() == 0


def test_reservations(spark):
    riders = spark.createDataFrame([(1, True, 2), (2, False, 0)], "uid long, online boolean, count long")
    asked = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "request_id long, rider_id long")
    after, got = M.reserve_riders(riders, asked)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 3)]
    assert sorted((r["uid"], r["count"]) for r in after.collect()) == [(1, 3), (2, 0)]


def test_percentile(spark):
    rows = spark.createDataFrame([(500.0, 0, 3), (1000.0, 0, 9), (1500.0, 1, 10)], "elapsed_ms double, retry_round int, terminal long")
    value = lambda p, frame=rows: R.completion_percentile(frame, 10, p).first()["elapsed_ms"]
    assert (value(50), value(99), value(50, rows.limit(0))) == (1000.0, 1500.0, 0.0)


def test_streams_survive_a_restart(spark, tmp_path):
    from fleetmatch.operators.batches import dedupe_inbox
    from fleetmatch.sources.event_log import tail_event_log
    from fleetmatch.streaming import streams as S

    rng = random.Random(8)
    rows = events(spark, *[(rng.randrange(20), rng.choice(KINDS)) for _ in range(200)])
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for k, part in enumerate(("offset_value < 90", "offset_value >= 60")):  # the second run brings 30 again
        rows.filter(part).coalesce(1).write.mode("append").parquet(source)
        stream = S.stream_order_state(tail_event_log(spark, source, "parquet", rows.schema))
        S.update_log(stream, out, str(tmp_path / "checkpoint")).awaitTermination()
        assert (tmp_path / "out" / f"batch={k}").exists()
    best = {}
    for r in spark.read.parquet(out).filter("changed").collect():
        if r["version"] > best.get(r["order_id"], {"version": -1})["version"]:
            best[r["order_id"]] = r
    inbox = spark.createDataFrame([], "consumer_name string, event_id string")
    want, _ = T.fold_order_state_tx(dedupe_inbox(rows, inbox, "w")[0])
    assert {k: {f: v[f] for f in ORDER_FIELDS} for k, v in best.items()} == {r["order_id"]: {f: r[f] for f in ORDER_FIELDS} for r in want.collect()}


def streamed(spark, rows, path, **options):
    """``rows`` as one more file of a stream's folder."""
    rows.coalesce(1).write.mode("append").parquet(path)
    return L.tail_event_log(spark, path, "parquet", rows.schema, **options)


def test_publication_claims_marks_and_tries_again(spark, tmp_path):
    from fleetmatch.streaming import streams as S

    schema = "event_id string, topic string, occurred_at long, published_at long, claimed_by string, claimed_until long, attempts int, last_error string"
    rows = [("e1", "a", 1, None, "", 0, 0, ""), ("e2", "b", 2, None, "", 0, 0, ""), ("e3", "x", 3, None, "", 0, 0, ""), ("e4", "a", 4, 9, "", 0, 0, ""), ("e5", "a", 5, None, "other", 10**12, 0, "")]
    out = str(tmp_path / "out")
    broken = {"b"}

    def append(part, path):
        if path.rsplit("topic=")[1] in broken:
            raise OSError("no broker")
        S.append_topic(part, path)

    def run(batch):
        stream = streamed(spark, spark.createDataFrame(batch, schema), str(tmp_path / "in"))
        S.publish_outbox_stream(stream, out, ["a", "b"], str(tmp_path / "checkpoint"), clock=lambda: 100, append=append).awaitTermination()

    state = lambda n: {r["event_id"]: (r["published_at"], r["claimed_by"], r["last_error"], r["attempts"]) for r in S.kept_outbox(spark, out, schema).rows(n + 1).collect()}
    run(rows)
    assert state(0) == {"e1": (100, "", "", 1), "e2": (None, "", "OSError: no broker", 1), "e3": (None, "", "unknown topic x", 1), "e4": (9, "", "", 0), "e5": (None, "other", "", 0)}
    broken.clear()
    run([("e6", "a", 6, None, "", 0, 0, "")])
    assert state(1) == {**state(0), "e2": (100, "", "", 2), "e3": (None, "", "unknown topic x", 2), "e6": (100, "", "", 1)}
    assert sorted(r["event_id"] for r in spark.read.parquet(out).collect()) == ["e1", "e2", "e6"]


def test_breaches_are_raised_by_samples_and_by_the_timer(spark, tmp_path):
    from fleetmatch.streaming import streams as S

    at = lambda minute: f"2024-01-01 00:{minute:02}:00"
    frame = lambda *rows: spark.createDataFrame([(s, at(m), b) for s, m, b in rows], "series string, ts string, bad boolean").selectExpr("series", "to_timestamp(ts) ts", "bad")
    path, out, checkpoint = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "checkpoint")
    steps = [[("quiet", 0, True), ("long", 0, True), ("short", 0, True)], [("long", 1, True), ("short", 1, False), ("clock", 5, False)], [("clock", 6, False), ("long", 7, False)], [("clock", 20, False)]]
    for rows in steps:
        stream = streamed(spark, frame(*rows), path)
        S.update_log(S.stream_sustained_breach(stream, 120, "0 seconds"), out, checkpoint, "append").awaitTermination()
    got = [(r["series"], r["open"], r["samples"]) for r in spark.read.parquet(out).collect()]
    assert ("quiet", True, 1) in got  # no further sample came
    assert ("long", True, 2) in got
    assert not any(s == "short" or s == "clock" for s, *_ in got)


def test_upserts_write_their_own_keys_only(spark, tmp_path):
    schema = "key long, value string, version long"
    path = str(tmp_path / "table")
    for rows in ([(k, "a", 1) for k in range(50)], [(3, "old", 0), (3, "b", 2), (99, "new", 1), (7, "late", 0)]):
        stream = streamed(spark, spark.createDataFrame(rows, schema), str(tmp_path / "in"))
        L.upsert_stream(stream, path, ["key"], "version", str(tmp_path / "checkpoint")).awaitTermination()
    got = {r["key"]: r["value"] for r in L.read_upserted(spark, path, schema, ["key"], "version").collect()}
    assert got == {**{k: "a" for k in range(50)}, 3: "b", 99: "new"}
    assert spark.read.parquet(f"{path}/level=0/upto=2").count() == 3


def test_runs_against_a_dictionary(spark, tmp_path):
    """Changes and deletions over many batches, some run again in part or whole; few runs, and deleted keys leave no trace."""
    from fleetmatch.sources.runs import Runs

    rng, schema, path = random.Random(9), "key long, day long, value long", str(tmp_path / "runs")
    want, levels = {}, lambda: {str(p.parent.name) + str(p.name) for p in (tmp_path / "runs").glob("level=*/upto=*")}
    for n in range(22):
        runs = Runs(spark, path, schema, ["key"], ("day",))
        changed = {k: (k % 3, n) for k in rng.sample(range(12), rng.randrange(0, 4))}
        gone = [k for k in rng.sample(range(12), 2) if k in want and k not in changed] if n % 2 else []
        frame = lambda rows: spark.createDataFrame([(k, *v) for k, v in rows], schema)
        for again in range(2 if n % 5 == 1 else 1):
            runs.merge(n)
            if n % 7 == 0 or again:
                assert {r.key: (r.day, r.value) for r in runs.rows(n).collect()} == want
                assert {r.key for r in runs.rows(n, F.col("day") == 1).collect()} == {k for k in want if k % 3 == 1}
            runs.add(frame(changed.items()), n, frame((k, want[k]) for k in gone))
        want = {k: v for k, v in {**want, **changed}.items() if k not in gone}
        assert len(levels()) <= 13
    assert runs.batches() == 22 and {r.key: (r.day, r.value) for r in runs.rows(22).collect()} == want


@pytest.mark.parametrize("idle", [None, 50])
def test_order_stream_writes_what_belongs_together(spark, tmp_path, idle):
    from fleetmatch.streaming import streams as S

    steps = [[(1, "order_created"), (1, "order_missed"), (2, "order_retry_request")], [(3, "order_created")], [(1, "order_created")]]
    for k, step in enumerate(steps):
        rows = events(spark, *step).withColumn("offset_value", F.col("offset_value") + 10 * k).withColumn("occurred_at", F.col("occurred_at") + 1000 * k)
        stream = streamed(spark, rows, str(tmp_path / "in"))
        S.apply_order_stream(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint"), idle).awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    # the first event comes again long after: known for good, or forgotten by then and applied to what is there
    want = [(1, "missed", 2), (3, "match_pending", 1), *([(1, "match_pending", 3)] if idle else [])]
    assert sorted((r["order_id"], r["status"], r["version"]) for r in read("orders").collect()) == sorted(want)
    first = read("outbox").filter("event_id = 'e0-match-requested' and occurred_at = 100").collect()
    assert [(r["topic"], r["payload"]) for r in first] == [("match-requests", '{"OrderID":1,"X":10,"Y":20,"Attempt":0}')]
    assert read("positions").agg({"offset_value": "max"}).first()[0] == 21


def test_rider_stream_starts_from_known_riders(spark, tmp_path):
    """Moves of a known rider count from the first batch on; the state is not loaded again after a restart."""
    from fleetmatch.streaming import streams as S

    known = spark.createDataFrame([(1, 5, 5, True), (2, 6, 6, False)], "uid long, x int, y int, online boolean")
    schema, out = "uid long, type string, x int, y int, seq long", str(tmp_path / "out")
    for step in ([(1, "move", 7, 7, 1), (2, "move", 8, 8, 2), (3, "move", 9, 9, 3)], [(1, "offline", 0, 0, 4), (2, "online", 1, 1, 5)], [(1, "move", 3, 3, 6)]):
        stream = streamed(spark, spark.createDataFrame(step, schema), str(tmp_path / "in"))
        S.update_log(S.stream_rider_state(stream, known), out, str(tmp_path / "checkpoint")).awaitTermination()
    rows = sorted((r["version"], r["uid"], r["x"], r["online"]) for r in spark.read.parquet(out).collect())
    assert rows == [(1, 1, 7, True), (2, 2, 6, False), (4, 1, 7, False), (5, 2, 1, True), (6, 1, 7, False)]


def test_seen_ids_are_kept_by_the_bucket():
    from fleetmatch.streaming.streams import _Seen

    class State(dict):
        calls = 0

        def getValue(self, key):
            self.calls += 1
            return self.get(key)

        def updateValue(self, key, value):
            self.calls += 1
            self[key] = value

    state, n = State(), 0
    for batch in ([f"e{i}" for i in range(2000)], ["e7", "x", "x"], [f"e{i}" for i in range(1990, 4000)]):
        seen, before = _Seen(state, n), state.calls
        new = [i for i in batch if seen.add(i)]
        seen.save()
        assert (len(new), state.calls - before <= len(batch) // 4 + 4) == ({2000: 2000, 3: 1, 2010: 2000}[len(batch)], True)
        n = seen.ids
    assert n == sum(len(ids) for (ids,) in state.values()) == 4001 and max(len(ids) for (ids,) in state.values()) < 4 * _Seen.BUCKET


class FakeStates:
    """What a stateful processor is given, for one key: values, maps and timers in memory, and the calls there were."""

    def __init__(self):
        self.calls, self.timers, self.watermark = 0, [], 0

    def getValueState(self, name, schema):
        return FakeState(self)

    def getMapState(self, name, key, schema):
        return FakeState(self)

    def registerTimer(self, at):
        self.timers.append(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark


class FakeState:
    def __init__(self, states):
        self.states, self.rows = states, {}

    def _called(self):
        self.states.calls += 1

    def exists(self):
        return self.get() is not None

    def get(self):
        self._called()
        return self.rows.get(())

    def update(self, row):
        self._called()
        self.rows[()] = row

    def getValue(self, key):
        self._called()
        return self.rows.get(key)

    def updateValue(self, key, row):
        self._called()
        self.rows[key] = row

    def clear(self):
        self._called()
        self.rows.clear()


def order_frame(n, each=3):
    import pandas as pd

    rows = [(i, f"e{i}-{k}", KINDS[(i + k) % len(KINDS)], i % 4, 10 * i + k, 100 + k, i, k, k, "why", 7, 8) for k in range(each) for i in range(n)]
    names = ["order_id", "event_id", "event_type", "shard_id", "offset_value", "occurred_at", "x", "y", "attempt", "reason", "rider_id", "score"]
    return pd.DataFrame(rows, columns=names)


def test_orders_of_a_bucket_share_calls_to_the_state():
    from fleetmatch.streaming.streams import _Orders

    states, orders = FakeStates(), _Orders(None)
    orders.init(states)
    frame = order_frame(300)
    (out,) = orders.handleInputRows((0,), iter([frame[:500], frame[500:]]), states)
    assert sorted(out.order_id) == list(range(300)) and states.calls < 100
    for r in out.to_dict("records"):
        own = frame[frame.order_id == r["order_id"]].sort_values("offset_value").to_dict("records")
        order = dict(zip(ORDER_FIELDS, BLANK, strict=True))
        for e in own if own[0]["event_type"] != "order_retry_request" else []:
            apply_event(order, e)
        assert {f: r[f] for f in ORDER_FIELDS} == order and r["next_offset"] == own[-1]["offset_value"] + 1
    (again,) = orders.handleInputRows((0,), iter([frame]), states)
    assert len(again) == 300 and not again.changed.any() and list(again.version) == list(out.version)


def test_orders_of_a_bucket_forget_each_for_itself():
    from fleetmatch.streaming.streams import _Orders

    states, orders = FakeStates(), _Orders(50)
    orders.init(states)
    frame = order_frame(40)
    (out,) = orders.handleInputRows((0,), iter([frame]), states)
    applied = set(out[out.changed].order_id)
    late = frame[frame.order_id == 1].assign(event_id="later", occurred_at=500)
    list(orders.handleInputRows((0,), iter([late]), states))
    assert states.timers == [1000 * 152] and orders.sizes.get()[:2] == (40, 3 * len(applied) + 1)
    states.watermark = 300_000
    list(orders.handleExpiredTimer((0,), states, None))
    assert orders.sizes.get() == (40, 4, True) and len(states.timers) == 2  # order 1 is kept
    (again,) = orders.handleInputRows((0,), iter([frame]), states)
    assert set(again[again.changed].order_id) == applied - {1}
    states.watermark = 10_000_000
    list(orders.handleExpiredTimer((0,), states, None))
    assert orders.sizes.get() == (40, 0, False) and len(states.timers) == 2


def test_an_event_on_an_order_is_the_fold(spark):
    kinds = [[(k,) for k in KINDS], [(a, b) for a in KINDS for b in KINDS], [(a, b, c) for a in KINDS for b in KINDS for c in KINDS]]
    every = [(i + 1, seq) for i, seq in enumerate(x for k in kinds for x in k)]
    log = events(spark, *[(i, k) for i, seq in every for k in seq]).cache()
    want, _ = T.fold_order_state_tx(log)
    fields = [f for f in want.schema.fields if f.name != "order_id"]
    kept = "struct<" + ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in fields) + ">"
    nth = F.row_number().over(Window.partitionBy("order_id").orderBy("offset_value"))
    steps, order = log.withColumn("nth", nth).cache(), None
    for n in (1, 2, 3):
        step = steps.filter(F.col("nth") == n)
        step = step.withColumn("order", F.lit(None).cast(kept)) if order is None else step.join(order, "order_id")
        done = T.apply_events_tx(step).select("order_id", "order").cache()
        order = done if order is None else done.unionByName(order.join(done, "order_id", "left_anti"))
    begun_well = {i for i, seq in every if seq[0] != "order_retry_request"}
    got = {r["order_id"]: r["order"].asDict() for r in order.collect() if r["order_id"] in begun_well}
    assert got == {r["order_id"]: {f.name: r[f.name] for f in fields} for r in want.collect()}


def test_a_retry_round_works_on_its_orders_only(spark, monkeypatch):
    from fleetmatch.operators import batches, greedy, ranks
    from fleetmatch.sources import tables

    rows, real, match = [0], tables.written, M.match_orders

    def counted(df):
        out = real(df)
        rows[-1] += out.count()
        return out

    def matched(*args, **options):
        rows.append(0)
        return match(*args, **options)

    for module in (M, greedy, ranks, batches, tables):
        monkeypatch.setattr(module, "written", counted, raising=False)
    monkeypatch.setattr(M, "match_orders", matched)
    orders = spark.range(1, 61).select(F.col("id").alias("order_id"), (F.col("id") % 50).cast("int").alias("x"), F.lit(5).alias("y"), F.col("id").alias("seq"))
    riders = spark.createDataFrame([(1, 5, 5, True, 0)], "uid long, x int, y int, online boolean, count long")
    M.retry_missed(orders, riders, Layout(area=100, cell=10, shards=1), 3)
    assert len(rows) == 5 and rows[3] <= rows[2]  # between the matchings of a round and the next nothing of the rounds before is written again


def test_riders_of_a_bucket_cost_one_call(spark):
    import pandas as pd

    from fleetmatch.streaming.streams import _Riders

    class State:
        value, calls = None, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    task, rows = _Riders(), [(u, kind, u, u + n, 10 * u + n) for u in range(100) for n, kind in enumerate(("move", "offline", "online", "move", "offline") if u else ("move", "offline"))]
    task.riders = State()
    out = pd.concat(task.handleInputRows((0,), iter([pd.DataFrame(rows, columns=["uid", "type", "x", "y", "seq"])]), None))
    assert sorted(out.itertuples(index=False, name=None)) == [(u, u, u + 3, False, 10 * u + 4) for u in range(1, 100)]
    assert task.riders.calls == 1


def test_stores_of_a_stream_do_not_grow_with_shuffle_partitions(spark, tmp_path):
    from fleetmatch.streaming import streams as S

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        rows = spark.createDataFrame([(u, "online", 1, 2, u) for u in range(50)], "uid long, type string, x int, y int, seq long")
        S.update_log(S.stream_rider_state(streamed(spark, rows, str(tmp_path / "in"))), str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len([p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]) <= spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50


def test_fields_of_an_event_are_those_of_its_text(spark):
    big = 3 * 10**9
    rows = [(1, 2, 3, 7, 5), (None, None, 4, None, None), (2**62, -5, 2**31 - 1, 2**62, -1), (4, big, 1, 8, 2), (5, 1, -big, 9, big)]
    frame = spark.createDataFrame(rows, "order_id long, x long, y long, rider_id long, score long")
    base = frame.withColumns({"event_id": F.lit("e"), "shard_id": F.lit(3), "occurred_at": F.lit(0).cast("long")})
    score = codec.clamped("score")
    result = F.when(F.col("rider_id").isNull(), "order_missed").otherwise("order_matched")
    made = [
        (codec.created_event(F.col("shard_id"), F.lit(0)), F.lit("order_created"), {"X": F.col("x"), "Y": F.col("y")}),
        (codec.retry_event(2, "late", F.lit(0)), F.lit("order_retry_request"), {"Attempt": F.lit(2), "Reason": F.lit("late")}),
        (codec.result_event(), result, {"RiderID": F.col("rider_id"), "Score": score, "Reason": F.lit("no_available_rider")}),
    ]
    for event, kind, values in made:
        want = codec.decode_payloads(base.select(*event))[0].select("event_type", *codec.FIELDS).collect()
        got = codec.with_fields(base.withColumn("event_type", kind), ["event_type"], OrderID=F.col("order_id"), **values)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want)) and len(want) in (3, 5)


def test_events_on_an_order_do_not_multiply_each_other(spark):
    rows = spark.range(1, 9).select(F.col("id").alias("order_id"), F.lit(None).cast(M.KEPT).alias("order"), F.concat(F.lit("order_"), F.col("id")).alias("event_type"))
    cases = []
    for n in range(3):
        rows = M._after(rows, X=F.lit(n), Attempt=F.lit(n), RiderID=F.lit(n), Score=F.lit(n)).select("order_id", "order", F.concat(F.lit("order_"), F.col("order_id") + n).alias("event_type"))
        cases.append(rows._jdf.queryExecution().optimizedPlan().toString().count("CASE"))
    assert cases[2] - cases[1] <= 2 * (cases[1] - cases[0])


@pytest.mark.parametrize(("options", "appended"), [({}, 1), ({"k": 1, "load_weight": 1}, 3)])
def test_retries_ask_only_where_there_is_room(spark, monkeypatch, options, appended):
    seed, calls, append = random.Random(4), [], M.append_to_ends
    orders = spark.createDataFrame([(i, seed.randrange(100), seed.randrange(100), seed.randrange(999)) for i in range(1, 81)], "order_id long, x int, y int, seq long")
    riders = spark.createDataFrame([(u, seed.randrange(50), seed.randrange(100), u % 5 > 0, u % 3) for u in range(1, 41 if options else 16)], "uid long, x int, y int, online boolean, count long")
    monkeypatch.setattr(M, "append_to_ends", lambda *args: calls.append(1) or append(*args))
    lay = Layout(area=100, cell=10, shards=4)
    got = sorted(map(tuple, M.retry_missed(orders, riders, lay, 2, **options).collect()))
    assert len(got) == 80 and len(calls) == appended
    cells = with_cell(orders, 10).select("cell_x", "cell_y").distinct()
    monkeypatch.setattr(M, "cells_with_room", lambda *args, **limits: cells)
    assert got == sorted(map(tuple, M.retry_missed(orders, riders, lay, 2, **options).collect()))
    assert len(calls) == appended + 3 and {r[2] for r in got if r[1] == "missed"} == {2}
