from decimal import Decimal

import pytest

from tallyfold.operators import experiments, explain, models
from tallyfold.session import shared_path
from tallyfold.sources import tables
from pyspark.sql import functions as F


def assembled(spark, n=200):
    return spark.createDataFrame([(i, int(i % 4 == 0), float(i % 4 == 0) * 5 + i % 3, float(i % 7)) for i in range(n)], "id long, label int, f_amount double, f_other double")


def test_models_separate_reload_and_weigh_features(spark):
    rows = assembled(spark)
    fitted = models.train(rows, trees=5, depth=3, rounds=3)
    scored = {r.id: r.risk_score for r in models.score(rows, fitted).collect()}
    assert min(s for i, s in scored.items() if i % 4 == 0) > max(s for i, s in scored.items() if i % 4)
    folder = shared_path(spark, "models")
    models.save(fitted, folder)
    assert {r.id: r.risk_score for r in models.score(rows, models.load(folder)).collect()} == scored
    weights = models.importances(fitted, ["f_amount", "f_other"], spark).collect()
    assert {r.feature for r in weights if r["rank"] == 1} == {"amount"}
    assert sum(r.importance for r in weights) == pytest.approx(2)
    assert models.score(rows.limit(3), {models.FOREST: fitted[models.FOREST]}).first().model_name == models.FOREST


@pytest.mark.parametrize("n, labels", [(9, 1), (100, 0)])
def test_training_needs_rows_of_both_classes(spark, n, labels):
    with pytest.raises(ValueError):
        models.train(assembled(spark, n).withColumn("label", F.col("label") * labels))


@pytest.mark.parametrize(
    "text, amount, said",
    [
        ("moved 181234.23 away", "181234.23", True),
        ("moved 181,234 away", "181234.23", True),
        ("about $181K", "181234.23", True),
        ("about 150,000", "181234.23", True),
        ("about 100,000", "181234.23", False),
        ("nothing", "5.00", False),
        ("it was 1,000.5", "1000.50", True),
    ],
)
def test_amount_is_found_in_any_notation(spark, text, amount, said):
    row = spark.createDataFrame([(1, text, None, Decimal(amount))], "id long, explanation_text string, risk_summary string, amount decimal(18,2)")
    assert (explain.validate_amount(row).first().flag is None) == said


def test_checks_of_nulls_and_accounts(spark):
    none = spark.createDataFrame([(1, None, None, None)], "id long, explanation_text string, risk_summary string, amount decimal(18,2)")
    assert explain.validate_amount(none).first().flag is None
    cases = [("account Z12345678", "C1", "M1", True), ("account Z12345678 and C1", "C1", "M1", False), ("Z12345678", "C1", "M1", False), (None, "C1", "M1", False), ("account Z12345678", None, "M1", False)]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "id long, explanation_text string, sender_account string, receiver_account string")
    assert {r.id: r.flag is not None for r in explain.validate_accounts(rows).collect()} == {i: c[3] for i, c in enumerate(cases)}


def test_responses(spark):
    whole = '{"riskSummary": "s", "explanationText": "t", "suspiciousPatterns": ["p"], "recommendedActions": [], "confidenceScore": 0.7}'
    raw = [whole, f"```json\n{whole}\n```", '{"riskSummary": "s", "suspiciousPatterns": ["p", "q', '{"riskSummary": "s", "confidenceScore": 0.4, "expl', "no", "", None]
    rows = spark.createDataFrame(list(enumerate(raw)), "id int, raw string")
    got = {r.id: r for r in explain.parse_responses(rows).collect()}
    assert [got[i].outcome for i in range(7)] == ["parsed", "parsed", "repaired", "partial", "error", "error", "error"]
    assert got[1].confidence_score == 0.7 and got[2].suspicious_patterns == ["p", "q"]
    assert (got[3].risk_summary, got[3].confidence_score) == ("s", 0.4)
    assert got[4].explanation_text == "no" and got[6].explanation_text == ""


def test_scores(spark):
    raw = ['{"score": 4}', '```json\n{"score": 4.5}\n```', '{"score": 0}', '{"score": 7}', '{"other": 3}', "x", "", None]
    got = {r.id: r.score for r in explain.parse_scores(spark.createDataFrame(list(enumerate(raw)), "id int, raw string")).collect()}
    assert [got[i] for i in range(8)] == [4.0, 4.5, None, None, None, None, None, None]


def test_retrieval_query(spark):
    rows = spark.createDataFrame([(1, "RAPID_VELOCITY: a: b; STRUCTURING: c", "CASH_OUT"), (2, None, None)], "id int, rule_triggered string, transaction_type string")
    got = {r.id: r.query_text for r in explain.retrieval_query(rows).collect()}
    assert got == {1: "rapid velocity structuring cash out fraud anomaly suspicious transaction", 2: "fraud anomaly suspicious transaction"}


def test_snapshots(spark):
    history = spark.sql("SELECT timestampadd(MINUTE, id, TIMESTAMP_NTZ '2025-01-01 00:00:00') AS snapshot_at, id AS n FROM range(10)")
    live = spark.sql("SELECT TIMESTAMP_NTZ '2025-01-02 00:00:00' AS snapshot_at, -1L AS n")
    now = lambda t: F.expr(f"TIMESTAMP_NTZ '2025-01-01 {t}'")
    assert experiments.latest_snapshot(history, live, now("00:10:00")).first().n == 9
    assert experiments.latest_snapshot(history, live, now("01:00:00")).first().n == -1
    assert [r.n for r in experiments.snapshot_history(history, now("00:10:00"), 3).collect()] == [7, 8, 9]


def test_alerts_are_appended_once(spark):
    path = shared_path(spark, "alerts")
    rows = spark.createDataFrame([(1, 10, "A"), (2, 10, "A"), (3, 10, "B")], "id long, transaction_id long, detection_config string")
    tables.append_alerts(rows, path)
    tables.append_alerts(rows, path, spark.read.parquet(path))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [1, 3]


def test_patterns_are_read_and_seeded_once(spark, tmp_path):
    file = tmp_path / "library.json"
    file.write_text('[{"patternType": "A", "title": "x", "description": "d", "indicators": ["i"]}, {"patternType": "A", "title": "x"}, {"patternType": "B", "title": "y"}]')
    library = tables.read_patterns(spark, str(file))
    assert sorted(r.title for r in tables.seed_patterns(library, library.limit(0)).collect()) == ["x", "y"]
    assert [r.title for r in tables.seed_patterns(library, library.where("patternType = 'A'")).collect()] == ["y"]


def test_a_replayed_batch_adds_nothing(spark):
    """Payments arrive as files, two of them twice; features and alerts equal those of the whole table."""
    from tallyfold.operators import detect, features, rules
    from tallyfold.streaming import increments

    schema = "id long, timestamp timestamp_ntz, sender_account string, receiver_account string, transaction_type string, amount decimal(18,2), sender_balance_before decimal(18,2), is_fraud boolean"
    rows = spark.range(60).selectExpr(
        "id", "timestampadd(MINUTE, CAST(id * 17 AS INT), TIMESTAMP_NTZ '2025-01-01 00:00:00') AS timestamp", "concat('C', id % 2) AS sender_account", "concat('M', id % 7) AS receiver_account",
        "'TRANSFER' AS transaction_type", "CAST(1000 * (id % 9) AS decimal(18,2)) AS amount", "CAST(2000 AS decimal(18,2)) AS sender_balance_before", "id % 5 = 0 AS is_fraud",
    )
    inbox, history, alerts, mark = (shared_path(spark, n) for n in ("inbox", "history", "alerts", "checkpoint"))
    limits = rules.threshold_table(spark, {"RAPID_VELOCITY": 2, "STRUCTURING": 10_000})

    def arrive(condition):
        rows.where(condition).coalesce(1).write.mode("append").parquet(inbox)
        increments.run(spark.readStream.schema(schema).parquet(inbox), history, alerts, limits, mark).processAllAvailable()
        for query in spark.streams.active:
            query.stop()

    for condition in ("id < 20", "id >= 20 AND id < 45", "id < 30", "id >= 40"):
        arrive(condition)
    assert sorted(r.id for r in spark.read.parquet(history).collect()) == list(range(60))
    feats = features.features_full(rows).withColumnRenamed("transaction_id", "id")
    want = {(r.id, r.rule_triggered) for r in detect.detect_rules(rows.join(feats, "id"), limits).collect()}
    got = [(r.id, r.rule_triggered) for r in spark.read.parquet(alerts).collect()]
    assert want and sorted(got) == sorted(want)


def test_rows_of_split_files_keep_their_numbers(spark, tmp_path):
    from tallyfold.sources import imports

    lines = [f"{i % 700},PAYMENT,{i}.00,C{i},0,0,M{i},0,0,0,0" for i in range(5000)]
    for name, part in (("a", lines[:3000]), ("b", lines[3000:])):
        (tmp_path / f"{name}.csv").write_text("\n".join([",".join(imports.COLUMNS), *part]) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "100")
    try:
        read = imports.read_raw(spark, str(tmp_path))
        assert read.rdd.getNumPartitions() > 4
        for r in read.collect():
            assert int(r.nameOrig[1:]) == r.row_num - 1 + (3000 if r.file.endswith("b.csv") else 0)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_shared_folder_is_required_on_a_cluster(spark):
    from types import SimpleNamespace

    from tallyfold import session

    bare = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, applicationId="x"), _jvm=spark._jvm, _jsc=spark._jsc)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(bare("yarn"))
    assert session.shared_folder(bare("local[2]")).endswith("/tallyfold-x")
