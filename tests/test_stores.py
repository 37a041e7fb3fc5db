"""Vector index, retrieval joined back, feature state, ranges, stored tables, buckets, percentiles, search lists and pages."""

import datetime
import math
import pathlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tallyfold.operators import context, features, lookups, ranking, retrieval, search_index, split, vector_index
from tallyfold.operators.state import FeatureState
from tallyfold.session import shared_path
from tallyfold.sources import bucketed, stored

TX = "id long, timestamp timestamp_ntz, sender_account string, receiver_account string, transaction_type string, amount decimal(18,2), sender_balance_before decimal(18,2), is_fraud boolean"


def payments(spark, n=300, senders=4, minutes=97, start="2025-01-01 00:00:00"):
    """Payments some hours apart, several weeks in all; some times are equal."""
    return spark.range(n).selectExpr(
        "id", f"timestampadd(MINUTE, CAST(id div 2 * {minutes} * 2 AS INT), TIMESTAMP_NTZ '{start}') AS timestamp", f"concat('C', id * 7 % {senders}) AS sender_account", "concat('M', id * id % 11) AS receiver_account",
        "'TRANSFER' AS transaction_type", "CAST(1000 * (id % 9) AS decimal(18,2)) AS amount", "CAST(2000 AS decimal(18,2)) AS sender_balance_before", "id % 5 = 0 AS is_fraud",
    )


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_read(df):
    """How many files the scan of a plan without an exchange reads."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().head()
    return leaf.metrics().apply("numFiles").value()


# times


@pytest.fixture
def zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    yield lambda name: spark.conf.set("spark.sql.session.timeZone", name)
    spark.conf.set("spark.sql.session.timeZone", before)


def test_features_and_split_are_the_same_in_a_zone_with_a_skipped_hour(spark, zone):
    """New York had no time between 2 and 3 o'clock on 2024-03-10; local times lie in that hour and around it."""
    rows = [(i, datetime.datetime(2024, 3, 10, 0, 30) + datetime.timedelta(minutes=15 * (i // 2)), f"C{i % 2}", f"M{i % 3}", "TRANSFER", 1000 * (i % 4), 5000, False) for i in range(40)]
    table = [(*r[:5], __import__("decimal").Decimal(r[5]), __import__("decimal").Decimal(r[6]), r[7]) for r in rows]
    found = {}
    for name in ("UTC", "America/New_York", "Europe/Berlin"):
        zone(name)
        tx = spark.createDataFrame(table, TX)
        found[name] = (sorted(map(str, features.with_features(tx).drop("timestamp").collect())), split.cutoff(tx, 0.8), sorted(map(str, split.temporal_split(tx).select("id", "is_training_set").collect())))
    assert found["UTC"] == found["America/New_York"] == found["Europe/Berlin"]


# vectors


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), "embedding")


def asked(vectors):
    return vectors.where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))


def test_the_index_finds_what_a_comparison_with_all_finds(spark, vectors):
    index = vector_index.build(vectors)
    want = {(r.query_id, r.doc_id) for r in retrieval.vector_topk(asked(vectors), vectors).collect()}
    got = {(r.query_id, r.doc_id) for r in vector_index.search(index, asked(vectors)).collect()}
    assert len(got & want) / len(want) >= 0.95
    exact = vector_index.search(index, asked(vectors), probes=1, exact=True)
    assert sorted(map(str, exact.collect())) == sorted(map(str, retrieval.vector_topk(asked(vectors), vectors).collect()))
    assert spark.read.parquet(f"{index.path}/lists").count() == vectors.count()


def test_a_search_reads_the_probed_lists_only(spark, vectors):
    index = vector_index.load(spark, vector_index.build(vectors, lists=30).path)
    one = asked(vectors).where("query_id = 0")
    units, _ = vector_index._units(one.toPandas()["q"])
    lists = vector_index._probed(index, units, 3)
    rows = vector_index.lists_of(spark, index, lists[0])
    assert {r.list for r in rows.select("list").distinct().collect()} == set(lists[0].tolist()) and len(lists[0]) == 3
    assert files_read(rows) == sum(len(list(pathlib.Path(index.path, f"lists/list={n}").glob("*.parquet"))) for n in lists[0]) < files_read(spark.read.parquet(f"{index.path}/lists"))


def test_copies_nulls_and_many_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)] + [(1000 + i, [1.0] + [0.0] * 7) for i in range(300)] + [(5000, None), (5001, [0.0] * 8)]
    docs = spark.createDataFrame(rows, "doc_id long, embedding array<double>")
    monkeypatch.setattr(vector_index, "PART", 50)
    monkeypatch.setattr(vector_index, "MOST_QUERIES", 10)
    index = vector_index.build(docs, lists=6)
    queries = docs.where("doc_id < 30 OR doc_id IN (1001, 5000, 5001)").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    got = sorted(map(tuple, vector_index.search(index, queries, exact=True).collect()))
    real = docs.where("doc_id < 5000").select("doc_id", F.col("embedding").cast("array<float>").alias("embedding"))
    want = sorted(map(tuple, retrieval.vector_topk(queries.where("query_id < 5000"), real).collect()))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[1] for g in got if g[0] == 1001] == [1000, 1001, 1002, 1003, 1004]
    assert vector_index.search(index, queries.limit(0)).count() == 0
    assert vector_index.search(vector_index.build(docs.limit(0)), queries).count() == 0


# retrieval


@pytest.mark.parametrize("most, parts", [(10_000, 32), (1, 8)])
def test_hot_questions_are_joined_back(spark, most, parts):
    rows = spark.range(400).selectExpr("id", "CASE WHEN id % 2 = 0 THEN 'hot' WHEN id % 7 = 0 THEN NULL ELSE concat('k', id % 5) END AS key")
    found = spark.createDataFrame([("hot", "H"), ("k1", "one"), ("k2", "two"), ("unused", "u")], "key string, said string")
    got = {r.id: (r.key, r.said) for r in context.joined_back(rows, found, "key", most=most, parts=parts).collect()}
    told = {"hot": "H", "k1": "one", "k2": "two"}
    assert got == {r.id: (r.key, told.get(r.key)) for r in rows.collect()}


def test_one_search_serves_all_alerts_of_a_question(spark, monkeypatch):
    searched = []
    monkeypatch.setattr(context, "vector_topk", lambda queries, docs, k: searched.append(queries.count()) or retrieval.vector_topk(queries, docs, k))
    alerts = spark.range(90).selectExpr("id", "CASE WHEN id % 3 = 0 THEN NULL ELSE concat('RAPID_VELOCITY: sender C', id, ' has many') END AS rule_triggered", "'CASH_OUT' AS transaction_type")
    patterns = spark.createDataFrame([("rapid velocity cash out",), ("rapid velocity",), ("unrelated words here",), ("",)], "text string")
    got = {r.id: r.context for r in context.with_context(alerts, patterns, 2).collect()}
    assert searched == [2] and len(got) == 90
    assert got[1].startswith("\n### Pattern 1\nrapid velocity cash out\n\n### Pattern 2\nrapid velocity")
    assert context.with_context(alerts, patterns.limit(0)).where("context IS NOT NULL").count() == 0


# state


def test_three_increments_equal_a_full_pass(spark):
    rows = payments(spark)
    names = ["id", *features.FEATURE_NAMES]
    want = sorted(map(str, features.with_features(rows).select(*names).collect()))
    state = FeatureState(spark, shared_path(spark, "state"))
    got = []
    for batch, part in enumerate(("id < 120", "id >= 120 AND id < 230", "id >= 230")):
        again = rows.where("id < 120").limit(5) if batch == 2 else rows.limit(0)  # stored rows that come again add nothing
        new = rows.where(part).unionByName(again)
        first = state.advance(new, batch).select(*names).collect()
        assert sorted(map(str, state.advance(new, batch).select(*names).collect())) == sorted(map(str, first))  # a batch run again
        got += first
    assert sorted(map(str, got)) == want
    assert state.rows().count() == 300


def test_a_large_batch_is_stored_in_parts(spark, tmp_path, monkeypatch):
    from tallyfold.operators import state as states

    monkeypatch.setattr(states, "PART", 100)
    rows = spark.range(1000).selectExpr("id", "timestamp_ntz '2024-01-04 00:00:00' + make_dt_interval(0, 0, CAST(id AS INT)) AS timestamp", "concat('S', id % 90) AS sender_account", "concat('R', id % 7) AS receiver_account", "CAST(id AS decimal(18,2)) AS amount")
    kept = FeatureState(spark, f"{tmp_path}/state")
    asked, known = [], kept.known
    monkeypatch.setattr(kept, "known", lambda new, batch: asked.append(batch) or known(new, batch))
    kept.advance(rows.withColumns({"transaction_type": F.lit("TRANSFER"), "sender_balance_before": F.lit(1).cast("decimal(18,2)")}), 0)
    weeks = list(pathlib.Path(f"{tmp_path}/state/batch=0").glob("week=*"))
    assert kept.rows().count() == 1000 and max(len(list(w.glob("*.parquet"))) for w in weeks) > 1 and asked == [0]


def test_an_increment_reads_its_weeks_only(spark):
    rows = payments(spark)
    state = FeatureState(spark, shared_path(spark, "state"))
    state.advance(rows.where("id < 280"), 0)
    weeks = {r.week for r in state.rows().select("week").distinct().collect()}
    near = state.rows(1).where(F.col("week").isin(state._weeks(rows.where("id >= 280"))))
    assert len(weeks) >= 3 and files_read(near) * 2 < files_read(state.rows())


def test_late_payments_count_what_lies_before_them(spark):
    rows = payments(spark, 60)
    state = FeatureState(spark, shared_path(spark, "state"))
    state.advance(rows.where("id % 4 <> 0"), 0)
    late = {r.id: str(r) for r in state.advance(rows.where("id % 4 = 0"), 1).select("id", *features.FEATURE_NAMES).collect()}
    want = {r.id: str(r) for r in features.with_features(rows).select("id", *features.FEATURE_NAMES).collect()}
    assert late == {i: want[i] for i in late} and len(late) == 15
    assert {(r.sender_account, r.receiver_account) for r in state.firsts().collect()} == {(r.sender_account, r.receiver_account) for r in rows.collect()}


# ranges


def test_ranges_of_accounts(spark):
    tx = payments(spark, 500).cache()
    rng, base = random.Random(2), datetime.datetime(2025, 1, 1)
    at = lambda: base + datetime.timedelta(minutes=rng.randrange(0, 50_000))
    rows = [(k, f"C{rng.randrange(6)}", *(sorted((at(), at())) if k % 9 else (at(), at()))) for k in range(10_000)]
    rows += [(10_000, "C1", None, base + datetime.timedelta(days=3)), (10_001, "C1", base + datetime.timedelta(days=3), None), (10_002, "C2", None, None), (10_003, None, None, None), (10_003, "C2", base, base)]
    asked = spark.createDataFrame(rows, "k long, account string, start timestamp_ntz, end timestamp_ntz")
    found = lookups.in_ranges(tx, asked)
    plan = plan_of(found)
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    have = tx.collect()
    inside = lambda r: [t for t in have if t.sender_account == r[1] and (r[2] is None or t.timestamp >= r[2]) and (r[3] is None or t.timestamp <= r[3])]
    some = [r for r in rows if r[0] % 101 == 0 or r[0] >= 10_000]
    got = {}
    for r in found.where("k % 101 = 0 OR k >= 10000").select("k", "id").collect():
        got.setdefault(r.k, []).append(r.id)
    want = {}
    for r in some:
        if inside(r):
            want.setdefault(r[0], []).extend(t.id for t in inside(r))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    stats = {(r.account, r.start, r.end): r for r in lookups.range_statistics(tx, asked).collect()}
    assert len(stats) == len({r[1:] for r in rows})
    for r in some:
        s, own = stats[r[1:]], [float(t.amount) for t in inside(r)]
        assert (s.n, s.receivers) == (len(own), len({t.receiver_account for t in inside(r)}))
        if own:
            assert (s.mean, s.sd) == (pytest.approx(np.mean(own), abs=1e-5), pytest.approx(np.std(own), abs=1e-3))
    assert lookups.in_ranges(tx, asked.limit(0)).count() == 0 and lookups.in_ranges(tx.limit(0), asked).count() == 0
    tx.unpersist()


# stored tables


def files_of(path):
    root = pathlib.Path(path.removeprefix("file:"))
    return {str(p.relative_to(root)) for p in root.rglob("*.parquet")}


def stored_alerts(spark, partitions="concat('c', id % 4)"):
    path = shared_path(spark, "alerts")
    spark.range(80).selectExpr("id", "id div 2 AS transaction_id", f"{partitions} AS detection_config", "'NEW' AS status").write.partitionBy("detection_config").parquet(path)
    return path


def test_a_change_replaces_touched_partitions_only_and_can_be_repeated(spark):
    path = stored_alerts(spark)
    before = files_of(path)
    updates = spark.createDataFrame([(1, "REVIEWED", 1), (1, "CONFIRMED", 2), (5, "DISMISSED", 1), (999, "REVIEWED", 1)], "id long, status string, at int")
    for _ in range(2):
        assert stored.update_status(spark, path, updates) == ["c1"]
        got = {r.id: r.status for r in spark.read.parquet(path).collect()}
        assert got == {i: {1: "CONFIRMED", 5: "DISMISSED"}.get(i, "NEW") for i in range(80)}
        after = files_of(path)
        assert {f for f in after if "c1" not in f} == {f for f in before if "c1" not in f}
        assert not {f for f in after if "c1" in f} & {f for f in before if "c1" in f}


def test_a_change_that_fails_changes_nothing(spark):
    path = stored_alerts(spark)
    before = files_of(path)
    touched = spark.createDataFrame([("c1",), ("c2",)], "detection_config string")
    fails = lambda rows: rows.withColumn("status", F.when(F.col("id") == 41, F.raise_error(F.lit("no"))).otherwise("X"))
    with pytest.raises(Exception, match="no"):
        stored.change(spark, path, "detection_config", touched, fails)
    with pytest.raises(ValueError, match="partitions"):
        stored.change(spark, path, "detection_config", touched, lambda rows: rows.withColumn("detection_config", F.lit("c3")))
    assert files_of(path) == before


def test_odd_partition_values_and_emptied_partitions(spark):
    path = stored_alerts(spark, "CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a/b=c d' WHEN 2 THEN '%' ELSE 'ü' END")
    gone = spark.range(80).where("id % 4 <> 3")
    assert len(stored.delete_rows(spark, path, "detection_config", gone, "id")) == 3
    assert {r.id for r in spark.read.parquet(path).collect()} == {i for i in range(80) if i % 4 == 3}
    assert {f.split("/")[0] for f in files_of(path)} == {"detection_config=ü"}
    assert stored.delete_rows(spark, path, "detection_config", gone, "id") == []


def test_the_cascade_and_clearing(spark):
    folder = shared_path(spark, "all")
    spark.range(40).selectExpr("id", "id % 5 AS day").write.partitionBy("day").parquet(f"{folder}/transactions")
    spark.range(40).selectExpr("id AS transaction_id", "id % 5 AS day").write.partitionBy("day").parquet(f"{folder}/features")
    spark.range(40).selectExpr("id + 100 AS id", "id AS transaction_id", "concat('c', id % 2) AS config").write.partitionBy("config").parquet(f"{folder}/alerts")
    spark.range(40).selectExpr("id + 200 AS id", "id + 100 AS alert_id", "concat('c', id % 2) AS config").write.partitionBy("config").parquet(f"{folder}/explanations")
    spark.range(1).write.parquet(f"{folder}/snapshots")
    by = {"transactions": "day", "features": "day", "alerts": "config", "explanations": "config"}
    read = lambda t, c: sorted(r[0] for r in spark.read.parquet(f"{folder}/{t}").select(c).collect())
    kept = files_of(f"{folder}/transactions")
    for _ in range(2):
        stored.delete_transactions(spark, folder, spark.createDataFrame([(5,), (15,)], "id long"), by)
        left = [i for i in range(40) if i not in (5, 15)]
        assert read("transactions", "id") == read("features", "transaction_id") == left
        assert read("alerts", "id") == [i + 100 for i in left] and read("explanations", "id") == [i + 200 for i in left]
        assert spark.read.schema("id long").parquet(f"{folder}/snapshots").count() == 0
    assert {f for f in files_of(f"{folder}/transactions") if "day=0" not in f} == {f for f in kept if "day=0" not in f}
    stored.clear(spark, folder, "alerts")
    assert not files_of(f"{folder}/alerts") and not files_of(f"{folder}/explanations") and read("transactions", "id") == left
    stored.clear(spark, folder, "transactions")
    assert not files_of(folder)


# buckets


def test_stored_ids_are_not_moved(spark):
    path = shared_path(spark, "bucketed")
    rows = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('x', id % 700) AS external_id", "id AS row_num")
    assert bucketed.add_transactions(rows(0, 500), "tx_b", path, 8).count() == 500
    assert sorted(r.row_num for r in bucketed.add_transactions(rows(400, 900), "tx_b", path, 8).collect()) == list(range(500, 700))
    assert bucketed.add_transactions(rows(0, 900), "tx_b", path, 8).count() == 0
    assert spark.table("tx_b").count() == 700
    from tallyfold.sources.imports import dedup_new

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(dedup_new(rows(0, 900), spark.table("tx_b")))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange hashpartitioning(external_id") == 1 and "SelectedBucketsCount: 8 out of 8" in plan
    other = bucketed.attach(spark, "tx_again", path, "external_id string, row_num long", ("external_id",), 8)
    assert other.count() == 700
    for name in ("tx_b", "tx_again"):
        spark.sql(f"DROP TABLE {name}")


# percentiles


def test_percentiles_of_groups(spark, monkeypatch):
    rng = np.random.default_rng(3)
    groups = {"hot": rng.integers(-(10**12), 10**12, 5000), "small": np.array([7]), "same": np.full(50, 3), "few": np.array([5, 1, 9, 9]), None: np.array([2, 4])}
    rows = [(g, int(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("few", None)]
    df = spark.createDataFrame(rows, "g string, x long")
    for p in (0.95, 0.5, 1.0, 0.001):
        got = {r.g: r.p for r in ranking.percentiles(df, ("g",), "x", p, "p").collect()}
        want = {g: sorted(xs.tolist())[max(1, math.ceil(p * len(xs) - 1e-9)) - 1] for g, xs in groups.items()} | {"none": None}
        assert got == want
    assert ranking.percentiles(df.limit(0), ("g",), "x", 0.5, "p").count() == 0
    passes, real = [], ranking.written
    monkeypatch.setattr(ranking, "written", lambda *a: passes.append(a[1]) or real(*a))
    one = spark.range(200_000).selectExpr("'all' AS g", "id * 31 % 1800 AS x")
    assert ranking.percentiles(one, ("g",), "x", 0.95, "p").first().p == 1709
    assert len(passes) <= 3


# searches


@pytest.mark.parametrize("text", ["C12", "c1", "m7", "M10", "12", "nothing", "C123", "%_", "1"])
def test_indexed_search_gives_the_scan_s_page(spark, tmp_path_factory, text):
    tx = payments(spark, 800, senders=150).withColumn("dataset_source", F.lit("PAYSIM")).withColumn("receiver_account", F.when(F.col("id") % 13 > 0, F.col("receiver_account")))
    path = test_indexed_search_gives_the_scan_s_page.__dict__.setdefault("path", shared_path(spark, "accounts"))
    if not pathlib.Path(path.removeprefix("file:")).exists():
        search_index.index_accounts(tx, path)
    for page, more in ((0, {}), (1, {"fraud": True})):
        want = [r.id for r in lookups.search_transactions(tx, account=text, page=page, size=7, **more).collect()]
        assert [r.id for r in search_index.search_by_account(spark, path, text, page, 7, **more).collect()] == want


def test_pages_of_a_sorted_table(spark):
    path = shared_path(spark, "sorted")
    rows = spark.range(200_000).selectExpr("id * 3 AS id", "id % 10 AS x")
    search_index.store_sorted(rows.orderBy(F.rand(1)), path, files=20)
    got = search_index.stored_page(spark, path, 1000, 25)
    assert [r.id for r in got.collect()] == [3 * (199_999 - 25_000 - k) for k in range(25)]
    assert len(got.inputFiles()) == 1
    some = search_index.stored_page(spark, path, 100, 25, where=F.col("x") == 3, descending=False)
    assert [r.id for r in some.collect()] == [3 * (10 * (2500 + k) + 3) for k in range(25)] and len(some.inputFiles()) <= 2
    after = search_index.page_after(spark, path, 300_001, 500)
    assert [r.id for r in after.collect()] == [3 * (100_001 + k) for k in range(500)] and len(after.inputFiles()) <= 2
    assert search_index.stored_page(spark, path, 10_000, 25).count() == 0 and search_index.page_after(spark, path, 10**9, 5).count() == 0
    across = search_index.page_after(spark, path, 0, 45_000)
    assert [r.id for r in across.collect()] == [3 * k for k in range(1, 45_001)]
