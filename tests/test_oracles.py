"""Registered queries against their oracle SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from tallyfold.plans import registry

SF = "/root/testdata/sf0.001"
SOME = ["features_full", "features_incremental", "rules_evaluate", "detect_full_system", "metrics_from_counts", "kfold_summary", "auc_by_fold", "significance", "import_dedup", "validate_all", "cost_breakdown", "winners", "vector_topk", "benchmark_all", "hallucination_breakdown", "data_quality", "comparison_pivot", "export_report", "run_snapshot", "feat_vector_json", "validate_amount", "response_parse", "score_parse", "delete_cascade"]


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return float(value) if isinstance(value, decimal.Decimal) else value


@pytest.mark.parametrize("name", SOME)
def test_query_equals_oracle(spark, name):
    con = duckdb.connect()
    for t in ("customer", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = con.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    rows = [dict(zip(want.columns, r, strict=True)) for r in want.fetchall()]
    key = lambda r: [plain(r[c]) for c in columns]
    assert sorted(map(key, df.collect()), key=str) == sorted(map(key, rows), key=str)
