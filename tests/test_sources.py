"""Type inference of a CSV against pandas, whose reader has the same rules."""

import pandas as pd
from pyspark.sql import functions as F

from cohort.sources import files as S

LINES = [
    "whole,gap,real,truth,lost_truth,word,none,mixed,exp",
    "1,1,1.5,True,True,a,,1,1e3",
    "2,,2,False,,NA,NA,x,-2.5E-2",
    '-3,3,NaN,true,False,"c, ""d"" e",null,2,inf',
    "+4,null,.5,FALSE,True,nan,,3.0,7",
]
NAMES = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string"}


def test_types_and_values_are_those_of_the_reader(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("\n".join(LINES) + "\n")
    df = S.read_csv_inferred(spark, str(path))
    want = pd.read_csv(path)
    assert dict(df.dtypes) == {c: NAMES[str(t)] for c, t in want.dtypes.items()}
    got = df.toPandas()
    for c in want.columns:
        if c == "mixed":
            continue        # numbers inside a text column keep their text
        a, b = want[c], got[c]
        assert (a.isna() == b.isna()).all(), c
        if a.dtype == object:   # truth values beside missing ones stay text here
            a = a.map(str, na_action="ignore")
        assert (a[a.notna()].to_numpy() == b[b.notna()].to_numpy()).all(), c


def test_large_whole_numbers_empty_columns_and_odd_names(spark):
    df = spark.createDataFrame([("1", "92233720368547758070", None), ("2", "1", "")],
                               "`a b` string, big string, `n.one` string")
    types = S.infer_types(df)
    assert types == {"a b": "bigint", "big": "double", "n.one": "double"}
    out = S.typed(df, types)
    assert out.columns == df.columns and [r["a b"] for r in out.collect()] == [1, 2]
    assert set(S.infer_types(df.where(F.lit(False))).values()) == {"double"}
