import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohort.functions import binning as B
from cohort.functions import numeric as N
from cohort.functions import text as T


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_ticket_prefix_cases(spark):
    vals = ["A/5 21171", "PC 17599", "113803", "C.A. 2343", "X 123", "C 123", None, "", "S.O.C. 14879"]
    got = _one(spark, T.ticket_prefix, vals)
    assert got == ["A5", "PC", "NONE", "CA", "OTHER", "C", "NAN", "OTHER", "SOC"]


def test_title_and_codes(spark):
    vals = ["Kelly, Mr. James", "Oliva y Ocana, Dona. Fermina", "no title here", None]
    assert _one(spark, T.title, vals) == ["Mr", "Dona", None, None]
    assert _one(spark, T.title_code, vals) == [1, None, None, None]
    assert _one(spark, T.title_grouped, vals) == ["Mr", "Other", "Other", "Other"]


def test_cabin_parts(spark):
    vals = ["F G73", "D", "B96 B98", None, "T"]
    assert _one(spark, T.first_letter, vals) == ["F", "D", "B", "U", "T"]
    assert _one(spark, lambda c: T.cabin_area(T.first_letter(c)), vals) == [
        "Lower_Deck", "Middle_Deck", "Top_Deck", "Unknown", "Staff"]
    assert _one(spark, T.first_number, vals) == [73.0, None, 96.0, None, None]
    assert _one(spark, T.presence_flag, vals) == [1, 1, 1, 0, 1]


def test_text_null_marker_and_coerce(spark):
    assert _one(spark, T.text_null_marker, [" NaN ", "nan", "x", None]) == [None, None, "x", None]
    assert _one(spark, N.coerce_numeric, ["12", "a1", None, "3.5"]) == [12.0, 0.0, 0.0, 3.5]


def test_bins_closed_sides(spark):
    ages = [0.0, 12.0, 16.0, 16.5, 20.0, 64.0, 64.1, 99.9, 100.0, -1.0, None]
    right = _one(spark, lambda c: B.cut_right(c, B.AGE_GROUP_EDGES), ages, "double")
    left = _one(spark, lambda c: B.cut_left(c, B.AGE_BAND5_EDGES), ages, "double")
    exp_r = pd.cut(pd.Series(ages, dtype=float), [-np.inf, 16, 32, 48, 64, np.inf], labels=False)
    exp_l = pd.cut(pd.Series(ages, dtype=float), [0, 12, 20, 40, 60, 100], labels=False,
                   right=False, include_lowest=True)
    norm = lambda s: [None if pd.isna(v) else int(v) for v in s]
    assert right == norm(exp_r)
    assert left == norm(exp_l)


@pytest.mark.parametrize("seed", range(5))
def test_quantile_code_matches_qcut(spark, seed):
    from cohort.operators.pipeline import quantile_edges
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6, 200).astype(float) if seed % 2 else rng.exponential(size=200)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    edges = quantile_edges(df, "x")
    got = [r[0] for r in df.select(B.quantile_code("x", F.array(*[F.lit(e) for e in edges]))).collect()]
    exp = pd.qcut(x, 4, labels=False, duplicates="drop")
    assert got == [None if pd.isna(v) else int(v) for v in exp]
