"""Input views assembled from the driver tables (FIXTURES §4-5).

The passenger-shaped view is built from ``orders`` joined to ``customer``;
the join is input assembly only (the reference itself has no join). Catalyst
picks the join strategy from table statistics (broadcast only under
``spark.sql.autoBroadcastJoinThreshold``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.sources.files import read_table

# Column roles of the passenger-shaped view.
VIEW_ROLES = {
    "id": "id", "label": "label", "pclass": "pclass", "name": "name", "sex": "sex",
    "age": "age", "sibsp": "sibsp", "parch": "parch", "ticket": "ticket",
    "fare": "fare", "cabin": "cabin", "embarked": "embarked",
}
# The view's "title" is the market segment between ', ' and '.': two segments
# share a code and one is left unmapped, to exercise the null path.
VIEW_TITLE_CODES = {"BUILDING": 1, "AUTOMOBILE": 2, "MACHINERY": 3, "HOUSEHOLD": 3}

PASSENGER_VIEW_SQL = """
SELECT o_orderkey AS id,
       CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
       CAST(substr(o_orderpriority, 1, 1) AS INT) AS pclass,
       concat(c_name, ', ', c_mktsegment, '. ', o_orderpriority) AS name,
       CASE WHEN c_nationkey % 2 = 0 THEN 'female' ELSE 'male' END AS sex,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_custkey % 80 AS DOUBLE) END AS age,
       c_nationkey % 4 AS sibsp,
       CAST(o_orderkey % 3 AS INT) AS parch,
       CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS VARCHAR(20))
            ELSE concat(substr(o_orderpriority, 3, 1), '/', CAST(o_custkey % 7 AS VARCHAR(20)), '. ', CAST(o_custkey AS VARCHAR(20))) END AS ticket,
       CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE o_totalprice END AS fare,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL
            ELSE concat(substr('ABCDEFGT', CAST(1 + o_custkey % 8 AS INT), 1), CASE WHEN o_custkey % 11 = 0 THEN '' ELSE CAST(o_custkey % 130 AS VARCHAR(20)) END) END AS cabin,
       CASE WHEN o_orderkey % 501 = 0 THEN NULL ELSE substr(c_mktsegment, 1, 1) END AS embarked
FROM orders JOIN customer ON o_custkey = c_custkey
"""


def passenger_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders as passenger-shaped rows (nulls injected by expression,
    no row is dropped)."""
    o = read_table(spark, sf_dir, "orders")
    c = read_table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    ck, ok = F.col("o_custkey"), F.col("o_orderkey")
    cabin_num = F.when(ck % 11 == 0, F.lit("")).otherwise((ck % 130).cast("string"))
    return j.select(
        ok.alias("id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("pclass"),
        F.concat("c_name", F.lit(", "), "c_mktsegment", F.lit(". "), "o_orderpriority").alias("name"),
        F.when(F.col("c_nationkey") % 2 == 0, "female").otherwise("male").alias("sex"),
        F.when(ok % 5 == 0, F.lit(None)).otherwise((ck % 80).cast("double")).alias("age"),
        (F.col("c_nationkey") % 4).alias("sibsp"),
        (ok % 3).cast("int").alias("parch"),
        F.when(ok % 2 == 0, ck.cast("string")).otherwise(F.concat(
            F.substring("o_orderpriority", 3, 1), F.lit("/"), (ck % 7).cast("string"),
            F.lit(". "), ck.cast("string"))).alias("ticket"),
        F.when(ok % 97 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("fare"),
        F.when(ok % 4 == 0, F.lit(None)).otherwise(F.concat(
            F.substring(F.lit("ABCDEFGT"), (1 + ck % 8).cast("int"), 1), cabin_num)).alias("cabin"),
        F.when(ok % 501 == 0, F.lit(None)).otherwise(
            F.substring("c_mktsegment", 1, 1)).alias("embarked"),
    )
