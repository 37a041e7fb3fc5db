import datetime
import hashlib
import math
import random
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyfold.operators import dashboards, detect, evaluate, explain, features, lookups, ranking, retrieval, rules, split
from tallyfold.sources import imports, tables

T0 = datetime.datetime(2025, 6, 15, 10, 30)
SCHEMA = "id long, timestamp timestamp_ntz, sender_account string, receiver_account string, transaction_type string, amount decimal(18,2), sender_balance_before decimal(18,2), is_fraud boolean"


def payments(spark, rows):
    """rows: (minutes from T0, sender, receiver, amount)"""
    return spark.createDataFrame(
        [(i, T0 + datetime.timedelta(minutes=m), s, r, "TRANSFER", Decimal(a), Decimal(2000), i % 3 == 0) for i, (m, s, r, a) in enumerate(rows)], SCHEMA
    )


def by_id(df, *columns):
    return {r.transaction_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_velocity_counts_only_the_past(spark):
    tx = payments(spark, [(-180, "A", "x", 1), (-120, "A", "x", 1), (-30, "A", "x", 1), (-10, "B", "x", 1), (0, "A", "x", 1)])
    assert by_id(features.features_full(tx), "tx_velocity_24h", "tx_velocity_1h")[4] == (3, 1)
    even = payments(spark, [(m, "A", "x", 1) for m in range(6)])
    assert [v[0] for _, v in sorted(by_id(features.features_full(even), "tx_velocity_24h").items())] == list(range(6))


def test_week_statistics_ratio_and_diversity(spark):
    tx = payments(spark, [(-40, "A", "R1", 100), (-30, "A", "R2", 200), (-20, "A", "R3", 300), (-10, "A", "R1", 500), (0, "A", "R4", 500)])
    got = by_id(features.features_full(tx), "avg_amount_7d", "amount_zscore", "amount_ratio_to_avg", "receiver_diversity_7d", "balance_change_ratio", "is_new_receiver")
    assert got[3][:3] == (Decimal("200.00"), round(300 / math.sqrt(20000 / 3), 6), 2.5)
    assert got[4][3:] == (3, 0.25, True)
    assert got[3][5] is False
    assert got[0][:3] == (Decimal("0.00"), 0.0, 0.0)


def test_incremental_adds_nothing_twice_and_agrees_with_full(spark):
    tx = payments(spark, [(7 * i % 50, "AB"[i % 2], f"R{i % 3}", 10 * i + 1) for i in range(30)])
    full = features.features_full(tx)
    assert features.features_incremental(tx, full).count() == 0
    part = features.features_incremental(tx, full.where("transaction_id < 20"))
    assert by_id(part, *full.columns) == {k: v for k, v in by_id(full, *full.columns).items() if k >= 20}


def test_split_is_by_discrete_percentile(spark):
    tx = payments(spark, [(60 * i, "A", "x", 1) for i in range(10)])
    assert [r.is_training_set for r in split.temporal_split(tx).orderBy("id").collect()] == [True] * 7 + [False] * 3
    folds = split.assign_folds(split.temporal_split(tx), 2)
    assert folds.where("is_training_set = (fold IS NOT NULL)").count() == 0
    with pytest.raises(ValueError):
        split.temporal_split(tx, 1.0)
    with pytest.raises(ValueError):
        split.assign_folds(folds, 1)


def test_rules_at_their_bounds(spark):
    rows = [("a", "10000.00", True, 5, True, 3), ("b", "9000.00", True, 1, False, 2), ("c", "200000.00", False, 2, True, 0), ("d", "50000.00", None, None, None, None)]
    df = spark.createDataFrame(
        [(s, Decimal(a), r, v, n, d, "S", "R") for s, a, r, v, n, d in rows],
        "id string, amount decimal(18,2), is_round_amount boolean, tx_velocity_1h int, is_new_receiver boolean, tx_velocity_24h int, sender_account string, receiver_account string",
    )
    th = rules.threshold_table(spark, {"LARGE_TRANSACTION": 200_000, "NEW_RECEIVER_HIGH_VALUE": 50_000})
    fired = {r.id: [x.name for x in r.results if x.triggered] for r in rules.evaluate(df, th).collect()}
    assert fired == {"a": ["RAPID_VELOCITY", "STRUCTURING"], "b": [], "c": ["LARGE_TRANSACTION", "NEW_RECEIVER_HIGH_VALUE"], "d": []}
    assert "threshold 200000" in rules.rule(df, th, "LARGE_TRANSACTION").where("id = 'c'").first().reason
    view = {r.rule_name: (r.at_default, r.outside_range) for r in rules.threshold_view(th).collect()}
    assert view["STRUCTURING"] == (True, False) and view["LARGE_TRANSACTION"] == (False, False)
    assert rules.update_threshold(th, "STRUCTURING", 5).count() == 3
    with pytest.raises(ValueError):
        rules.update_threshold(th, "STRUCTURING", 0)


def scored(spark, pairs):
    return spark.createDataFrame([(float(s), bool(y)) for s, y in pairs], "score double, is_fraud boolean")


@pytest.mark.parametrize(
    ("pairs", "roc", "pr"),
    [
        ([(0.9, 1), (0.8, 1), (0.7, 1), (0.3, 0), (0.2, 0), (0.1, 0)], 1.0, 1.0),
        ([(0.9, 0), (0.8, 0), (0.7, 0), (0.3, 1), (0.2, 1), (0.1, 1)], 0.0, None),
        ([(0.5, 1), (0.5, 0), (0.5, 1), (0.5, 0)], 0.5, 0.75),
        ([(0.5, 0), (0.4, 0)], math.nan, 0.0),
        ([(0.5, 1), (0.4, 1)], math.nan, 1.0),
    ],
)
def test_areas(spark, pairs, roc, pr):
    got = evaluate.auc(scored(spark, pairs)).first()
    assert got.auc_roc == roc or math.isnan(roc) and math.isnan(got.auc_roc)
    assert pr is None or got.auc_pr == pr


def test_counts_agree_with_rows(spark):
    tx = payments(spark, [(60 * i, "A", "x", 1) for i in range(100)])
    tx = split.temporal_split(tx)
    alerts = tx.where("id % 7 = 0 AND NOT is_training_set").select(F.col("id").alias("transaction_id"), F.lit("C").alias("detection_config"), F.lit(True).alias("is_anomaly"))
    m = evaluate.metrics(evaluate.counts(tx, alerts)).first()
    test = [i for i in range(100) if i >= 79]
    tp = sum(i % 7 == 0 and i % 3 == 0 for i in test)
    assert (m.tp, m.fp + m.tp, m.tp + m.fn, m.tp + m.fp + m.tn + m.fn) == (tp, sum(i % 7 == 0 for i in test), sum(i % 3 == 0 for i in test), len(test))


def test_student_p_at_tabulated_values(spark):
    table = [(12.706, 1), (4.303, 2), (3.182, 3), (2.776, 4), (2.262, 9), (2.093, 19)]
    df = spark.createDataFrame([(t, n) for t, n in table], "t double, n long")
    for r in df.select(evaluate.student_p(F.col("t"), F.col("n")).alias("p")).collect():
        assert abs(r.p - 0.05) < 1e-4


def test_significance_of_constant_and_equal_differences(spark):
    rows = [(c, f, 0.79 + 0.01 * f + d) for c, d in (("a", 0.0), ("b", 0.08), ("c", 0.0)) for f in range(5)]
    got = {(r.config_a, r.config_b): r for r in evaluate.significance(spark.createDataFrame(rows, "detection_config string, fold int, f1 double"), ("f1",)).collect()}
    assert len(got) == 3 and got["a", "b"].significant and got["a", "c"].p == 1.0


def test_import_reasons_in_order(spark, tmp_path):
    path = tmp_path / "raw.csv"
    head = ",".join(imports.COLUMNS)
    good = "1,transfer, 100.00 ,C1,0,0,M1,0,0,1,0"
    path.write_text("\n".join([head, good, good, "1,BARTER,1,C1,0,0,M1,0,0,0,0", "-1,PAYMENT,1,C1,0,0,M1,0,0,0,0", "1,PAYMENT,-500,C1,0,0,M1,0,0,0,0", "x,PAYMENT,1,C1,0,0,M1,0,0,0,0", "1,PAYMENT,0, ,0,0,M1,0,0,0,0"]))
    v = imports.validate(imports.read_raw(spark, str(path)))
    assert [r.reason for r in v.orderBy("row_num").collect()] == [None, None, "unknown type", "step out of range", "negative amount", "unparsable", "blank account"]
    rows = imports.typed(v)
    assert rows.first().external_id == "PAYSIM-1-C1-M1-100.00" and rows.first().timestamp == datetime.datetime(2025, 1, 1, 1)
    assert imports.dedup_new(rows, rows.limit(0)).count() == 1
    out = str(tmp_path / "tx")
    tables.append_rows(rows, out)
    assert spark.read.parquet(out).count() == 2


def test_full_system_keeps_score_only_if_flagged(spark):
    rows = spark.createDataFrame([(1, Decimal(300_000), False, 0, False, 0, "S", "R"), (2, Decimal(1), False, 0, False, 0, "S", "R"), (3, Decimal(1), False, 0, False, 0, "S", "R")],
        "id long, amount decimal(18,2), is_round_amount boolean, tx_velocity_1h int, is_new_receiver boolean, tx_velocity_24h int, sender_account string, receiver_account string")
    scores = spark.createDataFrame([(1, 0.2), (2, 0.5), (3, 0.4)], "id long, risk_score double")
    th = rules.threshold_table(spark, {"LARGE_TRANSACTION": 200_000})
    got = {r.transaction_id: (r.rule_triggered is not None, r.ml_risk_score) for r in detect.detect_full(rows, scores, th).collect()}
    assert got == {1: (True, None), 2: (False, 0.5)}


def test_nearest_documents(spark):
    docs = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(30)], "doc_id long, embedding array<double>")
    asked = docs.where("doc_id = 5").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    assert [r.doc_id for r in retrieval.vector_topk(asked, docs, 3).orderBy("rank").collect()] == [5, 4, 6]


def test_any_number_of_queries_is_answered_in_blocks(spark):
    docs = spark.createDataFrame([(i, [math.cos(i / 10), math.sin(i / 10)]) for i in range(30)], "doc_id long, embedding array<double>")
    asked = docs.select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    whole = retrieval.vector_topk(asked, docs, 3)
    parts = retrieval.vector_topk(asked, docs, 3, most_queries=7)
    assert parts.columns == whole.columns and len(rows := parts.collect()) == 90
    assert sorted(rows) == sorted(whole.collect())


def test_usual_vectors_meet_as_matrices_and_odd_ones_keep_their_ranks(spark, monkeypatch):
    rng = random.Random(3)
    usual = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(60)]
    rows = list(enumerate(usual + [usual[7]] * 40))
    odd = list(enumerate([None, None, [0.0] * 6, [0.0] * 6, [1.0, 2.0], [float("nan")] + [1.0] * 5, [1.0, None, 1.0, 1.0, 1.0, 1.0], []], 200))
    schema = "doc_id long, embedding array<float>"
    asked = lambda docs, where: docs.where(where).select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q"))
    docs, every = spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(rows + odd, schema).repartition(3)
    shown = lambda df: sorted(map(str, df.collect()))
    for d, where in ((docs, "doc_id % 3 < 2"), (every, "doc_id % 3 = 1 OR doc_id >= 200"), (every.where("doc_id >= 190"), "true"), (docs.where("doc_id < 3"), "true")):
        assert shown(retrieval.vector_topk(asked(d, where), d, 4, most_queries=30)) == shown(retrieval._compared(asked(d, where), d, 4))
    met = []
    monkeypatch.setattr(retrieval, "_pairs", None)
    matrices = retrieval._multiplied
    monkeypatch.setattr(retrieval, "_multiplied", lambda queries, docs, k: met.append(docs.count()) or matrices(queries, docs, k))
    assert retrieval.vector_topk(asked(docs, "doc_id < 10"), docs, 4).count() == 40
    assert met == [63]  # of the 41 copies the four that may be found


def test_percentile_is_exact_however_it_is_narrowed(spark):
    rng = random.Random(1)
    tx = payments(spark, [(rng.choice([0, 0, rng.randrange(5000), rng.randrange(9)]), "A", "x", 1) for _ in range(400)])
    for ratio in (0.01, 0.5, 0.8, 0.99):
        want = sorted(r.t for r in tx.selectExpr("unix_micros(CAST(timestamp AS timestamp)) AS t").collect())[math.ceil(Decimal(str(ratio)) * 400) - 1]
        assert [split.cutoff(tx, ratio, most, bins) for most, bins in ((1_000_000, 4096), (10, 4), (1, 3))] == [want] * 3
    assert split.cutoff(tx.limit(0)) is None and split.temporal_split(tx.limit(0)).count() == 0


def test_features_of_a_sender_with_half_of_all_rows(spark):
    """A hot sender and pair over many weeks, ties in time, and windows that end exactly at a payment, against plain loops."""
    rng = random.Random(2)
    rows = [(rng.choice([60, 1440, 10080]) * rng.randrange(30) + rng.choice([0, 0, 7]), "HOT" if i % 2 else f"S{i % 9}", f"R{min(rng.randrange(12), rng.randrange(12))}", 1 + i % 50) for i in range(500)]
    tx = payments(spark, rows)
    got = by_id(features.features_full(tx), "tx_velocity_1h", "tx_velocity_24h", "avg_amount_7d", "receiver_diversity_7d", "is_new_receiver")
    for i, (m, s, r, _) in enumerate(rows):
        past = [(m2, r2, a2) for m2, s2, r2, a2 in rows if s2 == s and m2 < m]
        week = [(r2, a2) for m2, r2, a2 in past if m2 >= m - 10080]
        mean = (Decimal(sum(a for _, a in week)) / len(week)).quantize(Decimal("0.01"), ROUND_HALF_UP) if week else Decimal("0.00")
        first = min((m2, j) for j, (m2, s2, r2, _) in enumerate(rows) if (s2, r2) == (s, r)) == (m, i)
        assert got[i] == (sum(m2 >= m - 60 for m2, _, _ in past), sum(m2 >= m - 1440 for m2, _, _ in past), mean, len({r2 for r2, _ in week}), first), (i, rows[i])
    assert {r.id: r.tx_velocity_1h for r in features.velocity(tx).collect()} == {i: g[0] for i, g in got.items()}
    assert {r.id: r.receiver_diversity_7d for r in features.receiver_diversity(tx).collect()} == {i: g[3] for i, g in got.items()}
    tied = {r.id: r.is_new_receiver for r in features.new_receiver(tx, ties_are_new=True).collect()}
    assert all(tied[i] == (m == min(m2 for m2, s2, r2, _ in rows if (s2, r2) == (s, r))) for i, (m, s, r, _) in enumerate(rows))


def test_busy_senders_and_the_others_have_the_same_features(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(rng.choice([0, 7, 60, 1440, 10080, rng.randrange(40000)]), rng.choice(["A", "A", "A", "B", "C", None]) if i % 2 else f"S{i % 40}", rng.choice(["x", "y", None]), rng.randrange(5000)) for i in range(300)]
    tx = payments(spark, rows).withColumn("timestamp", F.when(F.col("id") % 23 != 0, F.col("timestamp"))).withColumn("amount", F.when(F.col("id") % 19 != 0, F.col("amount")))
    found = []
    for few in (0, 8, 1000):
        monkeypatch.setattr(features, "FEW", few)
        found.append([sorted(map(str, df.collect())) for df in (features.features_full(tx), features.scoring(tx), features.signals(tx))])
    assert len(found[0][0]) == 300 and found[0] == found[1] == found[2]


def test_few_payments_take_one_shuffle(spark):
    tx = payments(spark, [(i, f"S{i % 5}", f"R{i % 3}", 10 * i) for i in range(40)])
    plan = features.with_features(tx)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Generate" not in plan


def test_running_sums_and_samples_over_many_ranges(spark):
    rows = spark.range(0, 1000, numPartitions=7).select(F.col("id"), (F.col("id") * 37 % 11).alias("x"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"))
    got = {r.id: r.s for r in ranking.running(rows, [F.desc("id")], {"s": F.col("x")}, ("k",)).collect()}
    assert got == {i: sum(j * 37 % 11 for j in range(i, 1000, 3)) for i in range(1000)}
    digest = lambda i: hashlib.md5(str(i).encode()).hexdigest()
    for n in (1, 100, 5000):
        assert [r.id for r in ranking.first_by_hash(rows, n).collect()] == sorted(range(1000), key=digest)[:n]
    labels = rows.withColumn("is_fraud", F.col("id") % 4 == 0)
    out = {r.id: r.is_training_set for r in split.stratified_split(labels).collect()}
    for fraud in (True, False):
        mine = [i for i in range(1000) if (i % 4 == 0) == fraud]
        assert [out[i] for i in mine] == [(k + 1) % 5 != 0 for k in range(len(mine))]


def test_significance_is_skipped_for_uneven_or_missing_folds(spark):
    rows = [(c, f, 0.8 + 0.01 * f * (1 + len(c))) for c in ("a", "bb") for f in range(5)] + [("ccc", f, 0.5) for f in range(4)] + [("dddd", f, math.nan if f == 2 else 0.7) for f in range(5)] + [("e", f, None) for f in range(5)]
    got = {(r.config_a, r.config_b): r for r in evaluate.significance(spark.createDataFrame(rows, "detection_config string, fold int, f1 double"), ("f1",), order=("bb",)).collect()}
    assert len(got) == 10 and got["bb", "a"].skip_reason is None and got["bb", "a"].alpha_corrected == 0.005
    assert {got[k].skip_reason for k in (("bb", "ccc"), ("ccc", "dddd"))} == {"fold-count mismatch or empty"}
    assert {got[k].skip_reason for k in (("a", "dddd"), ("a", "e"))} == {"NaN values in metric"}
    assert got["a", "e"].p is None and not got["a", "e"].significant


def test_searches_pages_and_maintenance(spark):
    tx = spark.createDataFrame([(i, "PAYSIM" if i % 2 else "CUSTOM", i % 5 == 0, "TRANSFER", f"C{i}", f"M{i % 3}", T0 + datetime.timedelta(hours=i)) for i in range(60)], "id long, dataset_source string, is_fraud boolean, transaction_type string, sender_account string, receiver_account string, timestamp timestamp_ntz")
    ids = lambda df: [r.id for r in df.collect()]
    assert ids(lookups.search_transactions(tx)) == list(range(59, 34, -1)) and ids(lookups.search_transactions(tx, page=2)) == list(range(9, -1, -1))
    assert ids(lookups.search_transactions(tx, source="CUSTOM", fraud=True, account="c2")) == [20]
    assert ids(lookups.sender_history(tx, tx.where("id IN (3, 4)"), start=T0 + datetime.timedelta(hours=4))) == [4]
    assert ids(lookups.keyset_page(tx, 57, 9)) == [58, 59]
    assert [r.paid_before for r in lookups.paid_before(tx.withColumn("sender_account", F.lit("C"))).orderBy("id").collect()] == [False] * 3 + [True] * 57
    alerts = spark.createDataFrame([(1, "NEW"), (2, "NEW"), (3, "NEW")], "id long, status string")
    updates = spark.createDataFrame([(1, "REVIEWED", 1), (1, "CONFIRMED", 2), (9, "X", 1)], "id long, status string, at int")
    assert sorted(map(tuple, lookups.update_status(alerts, updates).collect())) == [(1, "CONFIRMED"), (2, "NEW"), (3, "NEW")]
    results = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(5)], "id long, experiment_name string")
    assert ids(lookups.delete_results(results, [0, 4])) == [1, 2, 3] and ids(lookups.delete_results(results, name="a")) == [3, 4] and not ids(lookups.delete_results(results, everything=True))
    for wrong in (lambda: lookups.delete_results(results, list(range(1001))), lambda: lookups.paged(tx, [F.col("id")], -1)):
        with pytest.raises(ValueError):
            wrong()


def test_all_nine_checks(spark):
    names = "id int, risk_summary string, explanation_text string, n_patterns int, n_actions int, confidence_score double, amount decimal(18,2), sender_account string, receiver_account string, ml_risk_score double, explanation_type string"
    good = (1, "risk", "Sender C1 moved 500.00 to account M1", 1, 1, 0.5, Decimal(500), "C1", "M1", 0.7, "LLM_RAG")
    bad = [(2, " ", None, 0, None, 1.5, Decimal(500), "C1", "M1", 0.7, "LLM_RAG"), (3, "r", "account Z12345678 is low risk", 1, 1, 0.5, Decimal(5000), "C1", "M1", 0.95, "LLM_RAG"), (4, "500", "certainly fraud", 1, 1, 0.5, Decimal(500), "C1", "M1", 0.5, "LLM_DIRECT")]
    got = {r.id: r for r in explain.validate(spark.createDataFrame([good, *bad], names)).collect()}
    assert got[1].flags == [] and got[1].hallucination_free and got[1].explanation_type == "LLM_RAG_VALIDATED"
    assert got[2].flags == ["EMPTY_RISK_SUMMARY", "EMPTY_EXPLANATION_TEXT", "EMPTY_SUSPICIOUS_PATTERNS", "EMPTY_RECOMMENDED_ACTIONS", "CONFIDENCE_OUT_OF_RANGE"] and got[2].explanation_type == "LLM_RAG"
    assert got[3].flags == ["AMOUNT_NOT_REFERENCED", "POSSIBLE_ACCOUNT_FABRICATION", "RISK_DIRECTION_MISMATCH"] and got[4].flags == ["RISK_OVERCLAIM"]


def test_health_of_empty_tables(spark):
    tx = spark.createDataFrame([], "is_fraud boolean, is_training_set boolean")
    expl = spark.createDataFrame([], "hallucination_free boolean, completeness double")
    got = {r.check_id: r for r in dashboards.data_quality(tx, tx, tx, expl, tx).collect()}
    assert len(got) == 7 and got["transactions"].severity == "FAIL" and got["explanations"].severity == "PASS" and got["knowledge-base"].severity == "WARN"
    assert {r.overall for r in got.values()} == {"FAIL"}
