"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator key of the survey. Each reads the driver tables (whole tables,
no row caps) and calls library operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cohort.operators.pipeline import FeaturePipeline
from cohort.plans.views import VIEW_ROLES, VIEW_TITLE_CODES, passenger_view

REGISTRY: dict = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def view_pipeline(**kw) -> FeaturePipeline:
    return FeaturePipeline(roles=dict(VIEW_ROLES), title_codes=dict(VIEW_TITLE_CODES), **kw)


@query("feature_matrix")
def feature_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """E5 flagship: fit the pipeline on the view, transform the view."""
    v = passenger_view(spark, sf)
    return view_pipeline().fit(v).transform(v)


# ---------------------------------------------------------------------------
# helpers
import uuid  # noqa: E402

from pyspark.sql import functions as F  # noqa: E402

from cohort.functions import binning as B  # noqa: E402
from cohort.functions import numeric as N  # noqa: E402
from cohort.functions import text as T  # noqa: E402
from cohort.operators import aggregate as A  # noqa: E402
from cohort.operators import profile as PR  # noqa: E402
from cohort.operators.encode import encode_with, fit_codes, mode_value  # noqa: E402
from cohort.operators.pipeline import FEATURE_NAMES, column_quantiles, quantile_edges  # noqa: E402
from cohort.operators.scale import fit_scaler  # noqa: E402
from cohort.session import scratch_dir  # noqa: E402
from cohort.sources import files as S  # noqa: E402


def r6(c):
    """Aggregated doubles are rounded to 6 places (summation order differs
    between engines)."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def lineitem(spark, sf):
    return S.read_table(spark, sf, "lineitem")


def documents(spark, sf):
    return S.read_table(spark, sf, "documents")


def _fitted_matrix(spark, sf, **kw):
    v = passenger_view(spark, sf)
    return view_pipeline(**kw).fit(v).transform(v)


# ---------------------------------------------------------------------------
# sources / sinks
@query("csv_scan")
def csv_scan(spark, sf):
    """S1/S5 round trip: the view written as CSV (names hold commas) and read
    back with the header + quote-escape reader and an explicit schema."""
    v = passenger_view(spark, sf)
    path = scratch_dir(spark, f"csv-{uuid.uuid4().hex}")
    S.write_csv(v, path)
    schema = ", ".join(f"{n} {t}" for n, t in v.dtypes)
    return S.read_csv(spark, path, schema=schema)


@query("csv_infer")
def csv_infer(spark, sf):
    """The view written as CSV and read back with inferred types; per
    column its type, missing values and total (numbers only)."""
    path = scratch_dir(spark, f"csv-{uuid.uuid4().hex}")
    S.write_csv(passenger_view(spark, sf), path)
    df = S.read_csv_inferred(spark, path)
    types = dict(df.dtypes)
    rows = F.explode(F.array(*[F.struct(
        F.lit(c).alias("name"), F.lit(types[c]).alias("type"), F.col(c).isNull().cast("long").alias("m"),
        (F.col(c).cast("double") if types[c] in ("bigint", "double") else F.lit(None).cast("double"))
        .alias("v")) for c in df.columns])).alias("r")
    return df.select(rows).select("r.*").groupBy("name", "type").agg(
        F.sum("m").alias("missing"), F.round(F.sum("v"), 2).alias("total"))


@query("generate_ids")
def generate_ids(spark, sf):
    """Lineitem has no key; number its rows 1..n in full column order."""
    li = lineitem(spark, sf)
    out = S.with_generated_ids(li, "row_id", order_by=li.columns)
    return out.withColumn("l_shipdate", F.col("l_shipdate").cast("string"))


@query("submission_sink")
def submission_sink(spark, sf):
    """(id, int prediction) CSV written and read back."""
    v = passenger_view(spark, sf)
    pred = v.withColumn("pred", (F.col("pclass") <= 2).cast("int"))
    path = scratch_dir(spark, f"sub-{uuid.uuid4().hex}")
    S.write_csv(S.submission(pred, "id", "pred", "survived"), path)
    return S.read_csv(spark, path, schema="id long, survived int")


# ---------------------------------------------------------------------------
# projections / filters (P)
@query("align_columns")
def align_columns(spark, sf):
    """Same order as a trained column list; absent -> 0, extra dropped."""
    c = S.read_table(spark, sf, "customer")
    names = ["c_custkey", "c_acctbal", "c_phone", "c_nationkey"]
    return c.select([F.col(n) if n in c.columns else F.lit(0).alias(n) for n in names])


@query("filter_isin_range")
def filter_isin_range(spark, sf):
    """Set membership on two columns + closed range (null dropped)."""
    v = passenger_view(spark, sf)
    return v.where(F.col("sex").isin("female") & F.col("pclass").isin(1, 2)
                   & F.col("age").between(20, 40))


@query("preview_top5")
def preview_top5(spark, sf):
    """First five rows in id order (explicit order: limit is the feature)."""
    return passenger_view(spark, sf).orderBy("id").limit(5)


@query("table_shape")
def table_shape(spark, sf):
    """P9."""
    return PR.shape(passenger_view(spark, sf))


@query("pairs_complete_cases")
def pairs_complete_cases(spark, sf):
    """Six columns, complete rows only."""
    cols = ["label", "pclass", "age", "sibsp", "parch", "fare"]
    return passenger_view(spark, sf).select("id", *cols).na.drop("any", subset=cols)


@query("family_features")
def family_features(spark, sf):
    """X1/P13/B1."""
    v = passenger_view(spark, sf)
    fs = N.family_size("sibsp", "parch")
    return v.select("id", fs.alias("family_size"), N.is_alone(fs).alias("is_alone"),
                    B.cut_right(fs, B.FAMILY_TYPE_EDGES).alias("family_type"))


@query("missing_column_defaults")
def missing_column_defaults(spark, sf):
    """Absent source columns give the reference's defaults."""
    v = passenger_view(spark, sf).drop("name", "sex", "embarked", "ticket", "cabin")
    out = view_pipeline().fit(v).transform(v)
    return out.select("id", "title_code", "sex_code", "embarked_code", "ticket_frequency",
                      "ticket_prefix_code", "has_cabin", "cabin_location_code", "cabin_number")


ABSENT = ["age", "fare", "age_sq", "age_fare", "fare_sq", "cabin_number", "has_cabin",
          "fare_x_cabin_location_code", "age_band_x_sex", "age_x_family_size",
          "fare_per_person_x_class", "loneliness_score", "fare_sq_x_sex_code",
          "age_fare_x_sex_code"]


@query("transform_absent_columns")
def transform_absent_columns(spark, sf):
    """Fitted on all columns, then a batch without age, fare and cabin
    takes the fitted medians."""
    v = passenger_view(spark, sf)
    return view_pipeline().fit(v).transform(v.drop("age", "fare", "cabin")).select("id", *ABSENT)


POLY = ["age", "fare", "age_sq", "age_fare", "fare_sq"]
INTERACT = ["age_x_class", "fare_x_class", "sex_x_class", "age_band_x_sex", "embarked_x_class",
            "family_x_class", "fare_x_cabin_location_code", "age_x_family_size",
            "fare_per_person_x_class", "cabin_location_code_x_age_band", "title_code_x_class",
            "loneliness_score", "ticket_frequency_x_class", "ticket_prefix_code_x_class",
            "fare_sq_x_sex_code", "age_fare_x_sex_code"]


@query("poly_features")
def poly_features(spark, sf):
    """Degree-2 terms of (age, fare) in the reference's order."""
    return _fitted_matrix(spark, sf, wanted=tuple(POLY)).select("id", *POLY)


@query("interaction_features")
def interaction_features(spark, sf):
    """Products, guarded ratio, loneliness flag."""
    return _fitted_matrix(spark, sf, wanted=tuple(INTERACT)).select("id", *INTERACT)


# ---------------------------------------------------------------------------
# string functions (T)
@query("map_recode")
def map_recode(spark, sf):
    """Literal dictionary lookups; no match -> null."""
    v = passenger_view(spark, sf)
    return v.select("id", T.title("name").alias("title"),
                    T.map_lookup(T.title("name"), VIEW_TITLE_CODES).alias("title_code"),
                    T.sex_code("sex").alias("sex_code"))


@query("title_extract")
def title_extract(spark, sf):
    """T1 on whole document texts: first word between a space and a dot."""
    return documents(spark, sf).select("doc_id", T.title("text").alias("title"))


@query("title_grouped")
def title_grouped(spark, sf):
    """Kept titles stay, the rest (and null) become 'Other'."""
    kept = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"]
    t = T.title("name")
    v = passenger_view(spark, sf)
    return v.select("id", F.when(t.isin(*kept), t).otherwise(F.lit("Other")).alias("title_grouped"))


@query("ticket_prefix")
def ticket_prefix(spark, sf):
    """T4/T5."""
    v = passenger_view(spark, sf)
    return v.select("id", "ticket", T.ticket_prefix("ticket").alias("prefix"))


@query("cabin_features")
def cabin_features(spark, sf):
    """T6-T8/T10/N5 on the raw cabin: letter (null -> U), deck area, first
    number filled with the table's exact median, then 0."""
    v = passenger_view(spark, sf)
    num = T.first_number("cabin")
    med = column_quantiles(v.select(num.alias("n")), ["n"], [0.5])["n"][0]
    return v.select("id", T.presence_flag("cabin").alias("has_cabin"),
                    T.first_letter("cabin").alias("cabin_letter"),
                    T.cabin_area(T.first_letter("cabin")).alias("cabin_area"),
                    F.coalesce(num, F.lit(med).cast("double"), F.lit(0.0)).alias("cabin_number"))


@query("numeric_coerce")
def numeric_coerce(spark, sf):
    """Lenient text -> number, bad -> 0."""
    v = passenger_view(spark, sf)
    return v.select("id", N.coerce_numeric("ticket").alias("ticket_number"))


@query("text_null_marker")
def text_null_marker(spark, sf):
    """The text 'nan' (a missing value written as text) -> null."""
    v = passenger_view(spark, sf)
    txt = F.coalesce(F.col("cabin"), F.lit("nan"))
    return v.select("id", T.text_null_marker(txt).alias("cabin"))


# ---------------------------------------------------------------------------
# binning (B)
@query("bin_fixed_right")
def bin_fixed_right(spark, sf):
    """B1: right-closed bins; null age -> null bin."""
    v = passenger_view(spark, sf)
    return v.select("id", B.cut_right("age", B.AGE_GROUP_EDGES).alias("age_group"),
                    B.cut_right(N.family_size("sibsp", "parch"), B.FAMILY_TYPE_EDGES)
                    .alias("family_type"))


@query("bin_fixed_left")
def bin_fixed_left(spark, sf):
    """B2: left-closed bins, top edge excluded."""
    v = passenger_view(spark, sf)
    return v.select("id", B.cut_left("age", B.AGE_BAND5_EDGES).alias("age_band"))


@query("bin_quantile")
def bin_quantile(spark, sf):
    """Quartile codes of the median-filled fare over this table."""
    v = passenger_view(spark, sf)
    med = column_quantiles(v, ["fare"], [0.5])["fare"][0]
    f = v.select("id", F.coalesce("fare", F.lit(med)).alias("fare"))
    edges = quantile_edges(f, "fare")
    return f.select("id", B.quantile_code("fare", F.array(*[F.lit(e) for e in edges]))
                    .alias("fare_group"))


# ---------------------------------------------------------------------------
# missing values (N)
@query("impute_mode")
def impute_mode(spark, sf):
    """Most frequent value (tie -> smallest) fills nulls."""
    v = passenger_view(spark, sf)
    me, mc = mode_value(v, "embarked", "S"), mode_value(v, "cabin")
    return v.select("id", F.coalesce("embarked", F.lit(me)).alias("embarked"),
                    F.coalesce("cabin", F.lit(mc)).alias("cabin"))


@query("impute_median")
def impute_median(spark, sf):
    """Exact (interpolated) median fills nulls."""
    v = passenger_view(spark, sf)
    med = column_quantiles(v, ["age", "fare"], [0.5])
    return v.select("id", F.coalesce("age", F.lit(med["age"][0])).alias("age"),
                    F.coalesce("fare", F.lit(med["fare"][0])).alias("fare"))


@query("impute_mean")
def impute_mean(spark, sf):
    """Column means fill nulls."""
    v = passenger_view(spark, sf)
    ma, mf = v.agg(F.avg("age"), F.avg("fare")).first()
    return v.select("id", r6(F.coalesce("age", F.lit(ma))).alias("age"),
                    r6(F.coalesce("fare", F.lit(mf))).alias("fare"))


@query("impute_transform_fitted")
def impute_transform_fitted(spark, sf):
    """Imputers fitted on the full view, applied to a frame that lacks
    fare and cabin: only columns seen at fit and present now are filled."""
    v = passenger_view(spark, sf)
    model = view_pipeline().fit(v)
    return model.impute(v.drop("fare", "cabin")).select("id", "age", "embarked")


@query("fill_by_type")
def fill_by_type(spark, sf):
    """Text key -> mode, numeric key -> median."""
    v = passenger_view(spark, sf)
    band = B.cut_left("age", B.AGE_BAND7_EDGES, B.AGE_BAND7_LABELS)
    t = v.select("id", band.alias("age_band"), "fare")
    return t.select("id", A.fill_by_type(t, "age_band").alias("age_band"),
                    A.fill_by_type(t, "fare").alias("fare"))


@query("missing_profile")
def missing_profile(spark, sf):
    """Null count and percentage per column."""
    return PR.missing_profile(passenger_view(spark, sf)).select(
        "column", "n_missing", r6("pct_missing").alias("pct_missing"))


# ---------------------------------------------------------------------------
# encoding (E)
@query("label_encode")
def label_encode(spark, sf):
    """Codes by sorted value."""
    d = documents(spark, sf)
    codes = fit_codes(d, "lang")
    return encode_with(d.select("doc_id", "lang"), F.col("lang"), codes, "lang_code")


@query("encode_unknown_fallback")
def encode_unknown_fallback(spark, sf):
    """Classes fitted on the labelled documents' title words
    (rare ones collapsed, 'OTHER' always a class) and applied to every
    document: unseen or rare -> code of 'OTHER'."""
    d = documents(spark, sf)
    lab = S.read_table(spark, sf, "labels")
    train = d.join(lab.select("doc_id"), "doc_id", "left_semi")
    t = T.title("text")
    codes = fit_codes(train.select(t.alias("t")), "t", always=["OTHER"], min_count=10)
    return encode_with(d.select("doc_id", t.alias("title")), F.col("title"), codes,
                       "title_code", fallback="OTHER")


@query("rare_group")
def rare_group(spark, sf):
    """Title words seen fewer than 10 times collapse to 'OTHER'."""
    d = documents(spark, sf).select(T.title("text").alias("title"))
    return A.rare_values(d, "title", 10)


@query("standard_scale")
def standard_scale(spark, sf):
    """(x - mean) / population std over lineitem's measures."""
    li = lineitem(spark, sf)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    sc = fit_scaler(li, cols)
    return li.select("l_orderkey", "l_linenumber",
                     *[r6(sc.column(c)).alias(c) for c in cols])


@query("group_frequency")
def group_frequency(spark, sf):
    """Rows sharing the ticket, on every row."""
    v = passenger_view(spark, sf).select("id", "ticket")
    return A.group_frequency(v, "ticket", "ticket_frequency")


@query("dedupe_ordered")
def dedupe_ordered(spark, sf):
    """Each language once with its first position (doc id order)."""
    return A.first_occurrence(documents(spark, sf), "lang", "doc_id")


# ---------------------------------------------------------------------------
# aggregates (G)
def _li_labeled(spark, sf):
    """lineitem with the 0/1 stand-in label (returned line)."""
    li = lineitem(spark, sf)
    return li.withColumn("label", (F.col("l_returnflag") == "R").cast("int"))


@query("rate_by_key")
def rate_by_key(spark, sf):
    """G1: returned-line rate x100 by status and by line number, one scan."""
    out = A.rate_by_keys_long(_li_labeled(spark, sf), ["l_linestatus", "l_linenumber"], "label")
    return out.select("key_name", "key_value", r6("rate").alias("rate"), "n")


def _rate_sorted(df):
    return df.select("key", r6("rate").alias("rate"))


@query("rate_by_title")
def rate_by_title(spark, sf):
    """Rate by grouped title (text key: N6 fill with the mode)."""
    v = passenger_view(spark, sf)
    kept = ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"]
    t = T.title("name")
    key = F.when(t.isin(*kept), t).otherwise(F.lit("Other"))
    return _rate_sorted(A.rate_by_derived_key(v, key, "label"))


@query("rate_by_age_band")
def rate_by_age_band(spark, sf):
    """Seven labelled left-closed age bands; nulls take the mode
    band; every band listed (empty -> null rate)."""
    v = passenger_view(spark, sf)
    band = B.cut_left("age", B.AGE_BAND7_EDGES, B.AGE_BAND7_LABELS)
    return _rate_sorted(A.rate_by_derived_key(v, band, "label", categories=B.AGE_BAND7_LABELS))


@query("rate_by_fare_quintile")
def rate_by_fare_quintile(spark, sf):
    """Five labelled quantile bins of the median-filled fare."""
    v = passenger_view(spark, sf)
    med = column_quantiles(v, ["fare"], [0.5])["fare"][0]
    f = v.select(F.coalesce("fare", F.lit(med)).alias("fare"), "label")
    edges = quantile_edges(f, "fare", [0, 0.2, 0.4, 0.6, 0.8, 1.0])
    lab = B.quantile_label("fare", F.array(*[F.lit(e) for e in edges]), B.FARE_QUINTILE_LABELS)
    return _rate_sorted(A.rate_by_derived_key(f, lab, "label",
                                              categories=B.FARE_QUINTILE_LABELS))


@query("rate_by_family_type")
def rate_by_family_type(spark, sf):
    """Labelled right-closed family type."""
    v = passenger_view(spark, sf)
    ft = B.cut_right(N.family_size("sibsp", "parch"), B.FAMILY_TYPE_EDGES, B.FAMILY_TYPE_LABELS)
    return _rate_sorted(A.rate_by_derived_key(v, ft, "label", categories=B.FAMILY_TYPE_LABELS))


@query("rate_pivot")
def rate_pivot(spark, sf):
    """Rate by sex x class, wide, empty cell -> 0."""
    p = A.rate_pivot(passenger_view(spark, sf), "sex", "pclass", "label", [1, 2, 3, 4, 5],
                     prefix="class_")
    return p.select("sex", *[r6(f"class_{i}").alias(f"class_{i}") for i in range(1, 6)])


@query("category_share")
def category_share(spark, sf):
    """Share of each sex in percent."""
    s = A.category_share(passenger_view(spark, sf), "sex")
    return s.select("sex", "n", r6("share").alias("share"))


@query("describe_all")
def describe_all(spark, sf):
    """Describe every column of the view."""
    d = PR.describe_all(passenger_view(spark, sf))
    return d.select("column", "count", "unique", "top", "freq",
                    *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


VIEW_NUMERIC = ["id", "label", "pclass", "age", "sibsp", "parch", "fare"]


@query("corr_matrix")
def corr_matrix(spark, sf):
    """Pearson, pairwise-complete, numeric columns by type."""
    v = passenger_view(spark, sf)
    c = PR.corr_pairwise(v, PR.numeric_columns(v))
    return c.select("col_a", "col_b", r6("corr").alias("corr"))


@query("corr_matrix_features")
def corr_matrix_features(spark, sf):
    """37 features + label, pairwise-complete."""
    fm = _fitted_matrix(spark, sf)
    c = PR.corr_vector(fm, FEATURE_NAMES + ["label"])
    return c.select("col_a", "col_b", r6("corr").alias("corr"))


@query("missing_rows")
def missing_rows(spark, sf):
    """N10, row level: the missingness matrix."""
    return PR.missing_rows(passenger_view(spark, sf), "id")


@query("box_outliers")
def box_outliers(spark, sf):
    """The rows beyond whiskers of half the box's height."""
    li = lineitem(spark, sf).withColumn("l_extendedprice", F.col("l_extendedprice").cast("double"))
    return PR.box_outliers(li, "l_extendedprice", ["l_linenumber"], ["l_orderkey"], whisker=0.5)


# given predictions for metric operators: five fixed rules over lineitem
RULES = ("quantity", "discount", "tax", "price", "line")


def _rule(m):
    return {
        "quantity": lambda: F.col("l_quantity") / 50.0,
        "discount": lambda: F.col("l_discount") * 10.0,
        "tax": lambda: F.col("l_tax") * 12.5,
        "price": lambda: F.col("l_extendedprice") / 105000.0,
        "line": lambda: (F.col("l_linenumber") - 1) / 6.0,
    }[m]()


def _li_scored(spark, sf):
    li = _li_labeled(spark, sf)
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag", "label",
                     *[_rule(m).cast("double").alias(f"s_{m}") for m in RULES])


def _li_long(spark, sf):
    """Stacked (model, label, score, prediction) rows."""
    s = _li_scored(spark, sf)
    st = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(f"s_{m}").alias("score"))
                             for m in RULES])).alias("__m")
    return s.select("l_orderkey", "label", st).select(
        "l_orderkey", "label", "__m.model", "__m.score",
        (F.col("__m.score") > 0.5).cast("int").alias("prediction"))


@query("actual_vs_predicted_by_group")
def actual_vs_predicted_by_group(spark, sf):
    """Actual vs predicted rate per status and per line number."""
    s = _li_scored(spark, sf).withColumn("prediction", (F.col("s_quantity") > 0.5).cast("int"))
    out = A.actual_vs_predicted(s, ["l_linestatus", "l_linenumber"], "label", "prediction")
    return out.select("key_name", "key_value", r6("actual_rate").alias("actual_rate"),
                      r6("predicted_rate").alias("predicted_rate"), "n")


@query("actual_vs_predicted_overall")
def actual_vs_predicted_overall(spark, sf):
    """Per model, overall actual vs predicted rate."""
    out = A.overall_rates(_li_long(spark, sf), "model", "label", "prediction")
    return out.select("model", r6("actual_rate").alias("actual_rate"),
                      r6("predicted_rate").alias("predicted_rate"), "n")


@query("histogram")
def histogram(spark, sf):
    """30 equal-width bins of extended price, per label."""
    h = PR.histogram(_li_labeled(spark, sf), "l_extendedprice", "label", 30)
    return h.select("bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "hue", "n")


@query("kde_by_group")
def kde_by_group(spark, sf):
    """Gaussian KDE of quantity per label, 200 grid points, common norm."""
    k = PR.kde(_li_labeled(spark, sf), "l_quantity", ["label"], grid=200, cut=3.0)
    return k.select("label", "grid_idx", r6("x").alias("x"),
                    F.round("density", 10).alias("density"))


@query("box_stats")
def box_stats(spark, sf):
    """Box statistics of extended price by (line number, label)."""
    b = PR.box_stats(_li_labeled(spark, sf), "l_extendedprice", ["l_linenumber", "label"])
    return b.select("l_linenumber", "label", *[r6(c).alias(c) for c in
                                               ("q1", "median", "q3", "whisker_lo", "whisker_hi")],
                    "n_outliers", "n")


@query("violin_stats")
def violin_stats(spark, sf):
    """Per (line number, label) density (cut 2) with the quartiles."""
    li = _li_labeled(spark, sf)
    g = ["l_linenumber", "label"]
    k = PR.kde(li, "l_quantity", g, grid=200, cut=2.0, common_norm=False)
    b = PR.box_stats(li, "l_quantity", g).select(*g, "q1", "median", "q3")
    return k.join(b, g).select(*g, "grid_idx", r6("x").alias("x"),
                               F.round("density", 10).alias("density"),
                               r6("q1").alias("q1"), r6("median").alias("median"),
                               r6("q3").alias("q3"))


@query("scatter_points")
def scatter_points(spark, sf):
    """Complete (age, fare) points with the label as hue."""
    v = passenger_view(spark, sf)
    return v.where(F.col("age").isNotNull() & F.col("fare").isNotNull()).select(
        "id", "age", "fare", F.col("label").alias("hue"))


@query("scatter_binned")
def scatter_binned(spark, sf):
    """G17 at scale: 50 x 50 binned counts of (quantity, price) per label."""
    return PR.scatter_binned(_li_labeled(spark, sf), "l_quantity", "l_extendedprice", "label", 50)


@query("mean_abs_rank")
def mean_abs_rank(spark, sf):
    """Mean |value| per standardised lineitem measure, ranked."""
    li = lineitem(spark, sf)
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    z = fit_scaler(li, cols).transform(li)
    r = A.mean_abs_rank(z, cols)
    return r.select("feature", r6("importance").alias("importance"))


# ---------------------------------------------------------------------------
# metrics and folds (V, C6, C7)
from cohort.operators import metrics as MT  # noqa: E402
from cohort.operators.folds import hash_folds as _hash_folds  # noqa: E402
from cohort.operators.folds import stratified_folds as _strat  # noqa: E402


@query("classification_metrics")
def classification_metrics(spark, sf):
    """V4/V5: accuracy and macro precision/recall/F1 per rule model."""
    m = MT.classification_metrics(_li_long(spark, sf), "label", "prediction", ["model"])
    return m.select("model", *[r6(c).alias(c) for c in
                               ("accuracy", "precision_macro", "recall_macro", "f1_macro")], "n")


@query("confusion_matrix")
def confusion_matrix(spark, sf):
    """V6: full 2 x 2 grid per model."""
    return MT.confusion(_li_long(spark, sf), "label", "prediction", ["model"], classes=[0, 1])


@query("roc_curve")
def roc_curve(spark, sf):
    """V7: ROC point per distinct score per model."""
    r = MT.roc_points(_li_long(spark, sf), "label", "score", ["model"])
    return r.select("model", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"),
                    r6("tpr").alias("tpr"))


@query("roc_corners")
def roc_corners(spark, sf):
    """V7: start point and turning points of the ROC curve per model."""
    r = MT.roc_points(_li_long(spark, sf), "label", "score", ["model"], corners=True)
    return r.select("model", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"),
                    r6("tpr").alias("tpr"))


@query("auc")
def auc(spark, sf):
    """V7: AUC per model (trapezoid rule over the ROC points)."""
    return MT.auc(_li_long(spark, sf), "label", "score", ["model"]).select(
        "model", r6("auc").alias("auc"))


@query("stratified_folds")
def stratified_folds(spark, sf):
    """V1: exact unshuffled 3-fold split stratified by label."""
    v = passenger_view(spark, sf).select("id", "label")
    return _strat(v, "label", "id", 3)


@query("hash_folds")
def hash_folds(spark, sf):
    """V1: five folds by a seeded hash of the id, no ordering."""
    return _hash_folds(passenger_view(spark, sf).select("id", "label"), "id", 5)


@query("vote_hard")
def vote_hard(spark, sf):
    """Majority of the five rule models' predictions."""
    s = _li_scored(spark, sf)
    preds = [(F.col(f"s_{m}") > 0.5).cast("int") for m in RULES]
    return s.select("l_orderkey", "l_linenumber", "label", MT.hard_vote(preds).alias("vote"))


@query("vote_soft")
def vote_soft(spark, sf):
    """Mean positive probability of the five rules, then argmax."""
    s = _li_scored(spark, sf)
    probs = [F.least(F.greatest(F.col(f"s_{m}"), F.lit(0.0)), F.lit(1.0)) for m in RULES]
    mean, vote = MT.soft_vote(probs)
    return s.select("l_orderkey", "l_linenumber", "label", r6(mean).alias("p1"), vote.alias("vote"))
