"""Golden facts on the F1 passenger scoring file (FIXTURES section 3);
point COHORT_GOLDEN_CSV at it to run them."""
from pyspark.sql import functions as F

from cohort.functions import text as T
from cohort.operators import aggregate as A
from cohort.operators import profile as PR
from cohort.operators.encode import mode_value
from cohort.operators.pipeline import column_quantiles, quantile_edges


def test_csv_reads_like_pandas(passengers):
    assert passengers.count() == 418
    nulls = passengers.select([F.sum(F.col(c).isNull().cast("int")).alias(c) for c in ("Age", "Fare", "Cabin")]).first()
    assert (nulls["Age"], nulls["Fare"], nulls["Cabin"]) == (86, 1, 327)


def test_modes_and_medians(passengers):
    assert mode_value(passengers, "Embarked") == "S"
    assert mode_value(passengers, "Cabin") == "B57 B59 B63 B66"
    med = column_quantiles(passengers, ["Age", "Fare"], [0.5])
    assert med["Age"][0] == 27.0
    assert abs(med["Fare"][0] - 14.4542) < 1e-9


def test_title_groups(passengers):
    t = passengers.select(T.title_grouped("Name").alias("t")).groupBy("t").count()
    got = {r["t"]: r["count"] for r in t.collect()}
    assert got == {"Mr": 240, "Miss": 78, "Mrs": 72, "Master": 21, "Other": 7}


def test_ticket_prefix_rare_collapse(passengers):
    p = passengers.select(T.ticket_prefix("Ticket").alias("p"))
    rv = A.rare_values(p, "p", 10).groupBy("grouped").agg(F.sum("n").alias("n"))
    assert {r["grouped"]: r["n"] for r in rv.collect()} == {"NONE": 296, "OTHER": 63, "PC": 32, "CA": 27}


def test_ticket_frequency_sizes(passengers):
    f = A.group_frequency(passengers, "Ticket", "tf").groupBy("tf").count()
    assert {r["tf"]: r["count"] for r in f.collect()} == {1: 321, 2: 66, 3: 18, 4: 8, 5: 5}


def test_fare_quartiles_after_fill(passengers):
    f = passengers.select(F.coalesce("Fare", F.lit(14.4542)).alias("Fare"))
    edges = quantile_edges(f, "Fare")
    assert [round(e, 6) for e in edges] == [0.0, 7.8958, 14.4542, 31.471875, 512.3292]
    from cohort.functions.binning import quantile_code
    c = f.select(quantile_code("Fare", F.array(*[F.lit(e) for e in edges])).alias("c")).groupBy("c").count()
    assert [r["count"] for r in c.orderBy("c").collect()] == [114, 97, 102, 105]


def test_shares_and_correlations(passengers):
    s = {r["Sex"]: round(r["share"], 4) for r in A.category_share(passengers, "Sex").collect()}
    assert s == {"male": 63.6364, "female": 36.3636}
    c = PR.corr_pairwise(passengers, ["Age", "Fare", "Pclass"]).collect()
    got = {(r["col_a"], r["col_b"]): r["corr"] for r in c}
    assert abs(got[("Age", "Fare")] - 0.337932) < 1e-6
    assert abs(got[("Pclass", "Fare")] - (-0.577147)) < 1e-6
