"""Sources and sinks (S1-S6): CSV/Parquet scans, validation, id generation
and the submission sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")

# Passenger table layout (the reference's input file); Survived only in training.
PASSENGER_SCHEMA = T.StructType([
    T.StructField("PassengerId", T.IntegerType()),
    T.StructField("Survived", T.IntegerType()),
    T.StructField("Pclass", T.IntegerType()),
    T.StructField("Name", T.StringType()),
    T.StructField("Sex", T.StringType()),
    T.StructField("Age", T.DoubleType()),
    T.StructField("SibSp", T.IntegerType()),
    T.StructField("Parch", T.IntegerType()),
    T.StructField("Ticket", T.StringType()),
    T.StructField("Fare", T.DoubleType()),
    T.StructField("Cabin", T.StringType()),
    T.StructField("Embarked", T.StringType()),
])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One driver table; Parquet gives pushdown and column pruning."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_csv(spark: SparkSession, path: str,
             schema: T.StructType | str | None = None) -> DataFrame:
    """CSV with a header row. ``escape='"'`` makes doubled quotes
    inside quoted fields parse as one quote (pandas behaviour). Without a
    schema, types are inferred (one extra pass over the file)."""
    r = spark.read.option("header", True).option("escape", '"')
    if schema is not None:
        r = r.schema(schema)
    else:
        r = r.option("inferSchema", True)
    return r.csv(path)


# Texts that the reference's reader takes for a missing value, and
# for the two truth values.
NA_TEXTS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
            "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
TRUE_TEXTS, FALSE_TEXTS = ("True", "TRUE", "true"), ("False", "FALSE", "false")
_INT = r"^[ ]*[+-]?[0-9]+[ ]*$"
_NUMBER = r"(?i)^[ ]*[+-]?([0-9]+\.?[0-9]*([e][+-]?[0-9]+)?|\.[0-9]+([e][+-]?[0-9]+)?|inf|infinity)[ ]*$"


def infer_types(df: DataFrame) -> dict[str, str]:
    """Types of text columns by the reference reader's rules, in one aggregate:
    whole numbers are bigint, or double where a value is missing; other numbers,
    and columns without any value, double; truth values boolean if none is
    missing; everything else string. What a column shows of each kind merges by
    minimum and sum, so files and tasks may be taken in any order."""
    aggs = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        na = x.isNull() | x.isin(*NA_TEXTS)
        kinds = {"i": x.rlike(_INT) & F.trim(x).try_cast("bigint").isNotNull(), "f": x.rlike(_NUMBER),
                 "b": x.isin(*TRUE_TEXTS, *FALSE_TEXTS)}
        aggs.append(F.sum(na.cast("long")).alias(f"na{i}"))
        aggs.append(F.count(F.when(~na, 1)).alias(f"n{i}"))
        aggs += [F.min(F.when(~na, v)).alias(f"{k}{i}") for k, v in kinds.items()]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        missing = bool(r[f"na{i}"])
        if not r[f"n{i}"]:
            out[c] = "double"
        elif r[f"i{i}"]:
            out[c] = "double" if missing else "bigint"
        elif r[f"f{i}"]:
            out[c] = "double"
        else:
            out[c] = "boolean" if r[f"b{i}"] and not missing else "string"
    return out


def typed(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """Text columns in their inferred types; missing-value texts are null."""
    def column(c: str) -> Column:
        x = F.col(f"`{c}`")
        v = F.when(x.isin(*NA_TEXTS), F.lit(None)).otherwise(x)
        if types[c] == "boolean":
            return x.isin(*TRUE_TEXTS).alias(c)
        return (v if types[c] == "string" else F.trim(v).cast(types[c])).alias(c)
    return df.select(*[column(c) for c in df.columns])


def read_csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header row and types by ``infer_types``."""
    text = (spark.read.option("header", True).option("escape", '"').option("inferSchema", False).csv(path))
    return typed(text, infer_types(text))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV sink with header; each task writes its own part file."""
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """S3: reject an input that lacks a required column (e.g. the label)."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"input lacks required column(s): {missing}")
    return df


def with_generated_ids(df: DataFrame, id_col: str, order_by: list[str] | None = None,
                       dense: bool = True) -> DataFrame:
    """Add ``id_col`` if absent.

    ``dense=True`` numbers rows 1..n in ``order_by`` order without a
    single-task window (range partitioning + per-partition offsets, see
    ``operators.ordering``). ``dense=False`` only needs uniqueness and uses
    ``monotonically_increasing_id`` (no extra job).
    """
    if id_col in df.columns:
        return df
    if not dense:
        return df.withColumn(id_col, F.monotonically_increasing_id() + 1)
    from cohort.operators.ordering import positions
    keys = order_by or df.columns
    return positions(df, [], keys, "__pos").withColumn(
        id_col, F.col("__pos") + 1).drop("__pos")


def submission(df: DataFrame, id_col: str, pred_col: str,
               label_name: str = "Survived") -> DataFrame:
    """(id, int prediction) frame as written to the submission file."""
    return df.select(F.col(id_col), F.col(pred_col).cast("int").alias(label_name))


def nan_to_null(c: Column | str) -> Column:
    """Spark keeps NaN and NULL apart; the reference treats NaN as missing."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)
