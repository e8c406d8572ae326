"""Driver contract at sf0.001: entry runs, keys line up, cheap oracles match."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
CHEAP = ["csv_scan", "family_features", "ticket_prefix", "bin_quantile", "impute_median",
         "rate_by_age_band", "describe_all", "histogram", "box_stats", "classification_metrics",
         "roc_curve", "stratified_folds", "group_frequency", "label_encode", "feature_matrix",
         "clf_knn_exact"]


def _norm(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])

    def n(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 6)
        return v
    return sorted((tuple(n(r[i]) for i in order) for r in rows),
                  key=lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t))


def test_entry_and_keys(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("key", CHEAP)
def test_oracle_matches(spark, key):
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    con = duckdb.connect()
    for t in E.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[key](spark, SF)
    rel = con.sql(E.oracle_sql()[key])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _norm(df.columns, [tuple(r) for r in df.collect()]) == _norm(rel.columns, rel.fetchall())
