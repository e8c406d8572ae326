"""E5: the passenger feature pipeline as a fit / transform pair.

``FeaturePipeline.fit`` runs a handful of distributed aggregate jobs (modes,
exact medians, class tables); ``FeaturePipelineModel.transform`` is one lazy
plan of native expressions plus broadcast lookups of the fitted class tables.
Column names are parameters (``roles``), so any table can play the passenger
table. Output: id, label (when present) and the 37 features of the reference
in its order, as doubles.
"""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohort.functions import binning as B
from cohort.functions import numeric as N
from cohort.functions import text as T
from cohort.operators.encode import INLINE_MAX, encode_with, fit_classes
from cohort.operators.joins import attach_counts, lookup_join
from cohort.operators.quantiles import exact_quantiles
from cohort.sources.files import nan_to_null

PASSENGER_ROLES = {
    "id": "PassengerId", "label": "Survived", "pclass": "Pclass", "name": "Name",
    "sex": "Sex", "age": "Age", "sibsp": "SibSp", "parch": "Parch",
    "ticket": "Ticket", "fare": "Fare", "cabin": "Cabin", "embarked": "Embarked",
}

# Output features in the reference's order; the second name is its label there.
FEATURES = [
    ("pclass", "Pclass"), ("sibsp", "SibSp"), ("parch", "Parch"),
    ("family_size", "FamilySize"), ("is_alone", "IsAlone"), ("family_type", "FamilyType"),
    ("age_group", "AgeGroup"), ("age_x_class", "Age*Class"),
    ("fare_group", "FareGroup"), ("fare_x_class", "Fare*Class"),
    ("ticket_frequency", "TicketFrequency"), ("ticket_prefix_code", "TicketPrefix_Code"),
    ("has_cabin", "Has_Cabin"), ("cabin_location_code", "Cabin_Location_Code"),
    ("cabin_number", "Cabin_Number"),
    ("sex_code", "Sex_Code"), ("embarked_code", "Embarked_Code"), ("title_code", "Title_Code"),
    ("age", "Age"), ("fare", "Fare"), ("age_sq", "Age^2"), ("age_fare", "Age Fare"),
    ("fare_sq", "Fare^2"),
    ("sex_x_class", "Sex*Class"), ("age_band_x_sex", "Age_Group*Sex"),
    ("embarked_x_class", "Embarked*Class"), ("family_x_class", "Family*Class"),
    ("fare_x_cabin_location_code", "Fare*Cabin_Location_Code"),
    ("age_x_family_size", "Age*FamilySize"),
    ("fare_per_person_x_class", "FarePerPerson*Class"),
    ("cabin_location_code_x_age_band", "Cabin_Location_Code*Age_Group"),
    ("title_code_x_class", "Title_Code*Class"),
    ("loneliness_score", "Loneliness_Score"),
    ("ticket_frequency_x_class", "TicketFrequency*Class"),
    ("ticket_prefix_code_x_class", "TicketPrefix_Code*Class"),
    ("fare_sq_x_sex_code", "Fare^2*Sex_Code"),
    ("age_fare_x_sex_code", "Age Fare*Sex_Code"),
]
FEATURE_NAMES = [f for f, _ in FEATURES]

# Fixed values of the reference: fallbacks and defaults.
OTHER_PREFIX = "OTHER"
UNKNOWN_AREA = "Unknown"
DEFAULT_PORT = "S"
FARE_QUARTILES = (0.0, 0.25, 0.5, 0.75, 1.0)


def column_quantiles(df: DataFrame, cols: list[str], probs) -> dict:
    """Exact quantiles of several columns in one distributed job set:
    the columns are unpivoted into (column, value) and grouped by column."""
    if not cols:
        return {}
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("col"), F.col(c).cast("double").alias("v")) for c in cols]))
        .alias("__s")).select("__s.col", "__s.v")
    rows = exact_quantiles(long, "v", probs, ["col"]).collect()
    out = {c: [None] * len(probs) for c in cols}
    for r in rows:
        out[r["col"]][r["q_idx"]] = r["value"]
    return out


def quantile_edges(df: DataFrame, col: str, probs=FARE_QUARTILES) -> list:
    """B5 edges: exact interpolated quantiles, duplicates dropped, sorted."""
    vals = column_quantiles(df, [col], probs)[col]
    return sorted({v for v in vals if v is not None})


#: The features that a step - a fitted state, a join or a batch statistic - is
#: made for; a pipeline runs the steps of its wanted features only.
DECK = ("cabin_location_code", "fare_x_cabin_location_code", "cabin_location_code_x_age_band")
STEPS = {
    "ticket_frequency": ("ticket_frequency", "ticket_frequency_x_class"),
    "ticket_prefix": ("ticket_prefix_code", "ticket_prefix_code_x_class"),
    "deck": DECK,
    "cabin_number": ("cabin_number",),
    "cabin": ("has_cabin", "cabin_number", *DECK),
    "port": ("embarked_code", "embarked_x_class"),
    "fare_group": ("fare_group",),
    # both medians or none: an absent column takes its median if both are known
    "medians": ("age_group", "age_x_class", "fare_group", "fare_x_class", "age", "fare", "age_sq",
                "age_fare", "fare_sq", "age_band_x_sex", "fare_x_cabin_location_code",
                "age_x_family_size", "fare_per_person_x_class", "cabin_location_code_x_age_band",
                "loneliness_score", "fare_sq_x_sex_code", "age_fare_x_sex_code"),
}


def steps_of(wanted) -> set:
    return {step for step, feats in STEPS.items() if set(feats) & set(wanted)}


@dataclass
class FeaturePipeline:
    """Estimator. ``bins='batch'`` reproduces the reference (quartile bins
    and ticket frequency computed on the batch being transformed);
    ``bins='fitted'`` freezes both at fit time (streaming, leak-free).
    ``wanted``: the features to make (all if not given), which decide the state
    that is fitted and the joins that a transform needs."""
    roles: dict = field(default_factory=lambda: dict(PASSENGER_ROLES))
    rare_min: int = 10
    title_codes: dict = field(default_factory=lambda: dict(T.TITLE_CODES))
    bins: str = "batch"
    flag_before_impute: bool = False
    wanted: tuple | None = None

    def _has(self, df: DataFrame, role: str) -> bool:
        return self.roles.get(role) in df.columns

    def fit(self, df: DataFrame) -> "FeaturePipelineModel":
        """Two passes over the input: (1) value counts of port, cabin, ticket
        prefix and deck area in one aggregate (modes, null presence and class
        lists all come from it); (2) exact medians of age, fare and the cabin
        number of the imputed rows in one quantile job set."""
        r = self.roles
        st: dict = {"roles": r, "rare_min": self.rare_min, "bins": self.bins,
                    "title_codes": self.title_codes,
                    "flag_before_impute": self.flag_before_impute}
        wanted = [f for f in FEATURE_NAMES if self.wanted is None or f in self.wanted]
        unknown = set(self.wanted or ()) - set(FEATURE_NAMES)
        if unknown:
            raise ValueError(f"no such features: {sorted(unknown)}")
        st["wanted"], need = wanted, steps_of(wanted)
        has = {role: self._has(df, role) for role in r}
        cats = {}
        if has["embarked"] and "port" in need:
            cats["embarked"] = F.col(r["embarked"]).cast("string")
        if has["cabin"] and "cabin" in need:
            cats["cabin"] = F.col(r["cabin"]).cast("string")
        if has["cabin"] and "deck" in need:
            cats["area"] = F.when(F.col(r["cabin"]).isNotNull(),
                                  T.cabin_area(T.first_letter(r["cabin"])))
        if has["ticket"] and "ticket_prefix" in need:
            cats["prefix"] = T.ticket_prefix(r["ticket"])
        vc = None
        if cats:
            vc = (df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("name"), e.alias("value"))
                                                for k, e in cats.items()])).alias("__c"))
                  .select("__c.*").groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
                  .cache())
            summary = {row["name"]: row for row in vc.groupBy("name").agg(
                F.min_by("value", F.when(F.col("value").isNotNull(),
                                         F.struct(-F.col("n"), F.col("value")))).alias("mode"),
                F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("nulls"),
                F.count("value").alias("distinct")).collect()}
        else:
            summary = {}

        def mode(name):
            return summary[name]["mode"] if name in summary else None

        def has_nulls(name):
            return name in summary and summary[name]["nulls"] > 0

        def codes(name, extra=(), min_count=None):
            q = vc.where((F.col("name") == name) & F.col("value").isNotNull())
            if min_count is not None:
                q = q.where(F.col("n") >= min_count)
            got = [x["value"] for x in q.select("value").limit(INLINE_MAX + 1).collect()]
            if len(got) + len(extra) <= INLINE_MAX:
                return sorted(set(got) | {e for e in extra if e is not None})
            table = fit_classes(q.select("value"), "value", always=[e for e in extra if e])
            return table

        # Most frequent port and cabin (tie -> smallest)
        st["mode_embarked"] = mode("embarked")
        st["mode_cabin"] = mode("cabin")
        tables = {}
        # E3 + E1: ticket prefixes, rare ones collapsed, 'OTHER' always a class
        if "ticket_prefix" in need:
            tables["ticket_prefix"] = (codes("prefix", [OTHER_PREFIX], self.rare_min)
                                       if has["ticket"] else ["NONE", OTHER_PREFIX])
        # deck areas of the imputed cabins ('Unknown' always a class; it sorts last)
        extra = [UNKNOWN_AREA]
        if has["cabin"] and has_nulls("cabin"):
            mc = st["mode_cabin"]
            extra.append(_area_of(mc))
        if "deck" in need:
            tables["cabin_area"] = codes("area", extra) if has["cabin"] else [UNKNOWN_AREA]
        # N4 + E1: port mode then port classes of the imputed ports
        if has["embarked"] and "port" in need:
            st["port_mode"] = st["mode_embarked"] if st["mode_embarked"] is not None else DEFAULT_PORT
            tables["port"] = codes("embarked", [st["port_mode"]] if has_nulls("embarked") else [])
        # N2 + N5: exact medians in one job set
        num = {}
        if has["age"] and "medians" in need:
            num["age"] = nan_to_null(r["age"])
        if has["fare"] and "medians" in need:
            num["fare"] = nan_to_null(r["fare"])
        if has["cabin"] and "cabin_number" in need:
            num["cabin_number"] = T.first_number(
                F.coalesce(F.col(r["cabin"]), F.lit(st["mode_cabin"]).cast("string")))
        med = {}
        if num:  # several passes
            values = df.select(*[e.alias(k) for k, e in num.items()]).cache()
            med = column_quantiles(values, list(num), [0.5])
            values.unpersist()
        st["median_age"] = med.get("age", [None])[0]
        st["median_fare"] = med.get("fare", [None])[0]
        st["median_cabin_number"] = med.get("cabin_number", [None])[0]
        if vc is not None:
            vc.unpersist()
        if self.bins == "fitted":
            imp = FeaturePipelineModel(st, {}).impute(df)
            if has["fare"] and "fare_group" in need:
                st["fare_edges"] = quantile_edges(imp, r["fare"])
            if has["ticket"] and "ticket_frequency" in need:
                tables["ticket_counts"] = (imp.groupBy(F.col(r["ticket"]).alias("value"))
                                           .agg(F.count(F.lit(1)).alias("n"))
                                           .where(F.col("value").isNotNull()))
        # small class lists live in the state; large ones stay tables
        for k in list(tables):
            if isinstance(tables[k], list):
                st[f"codes_{k}"] = tables.pop(k)
            else:
                tables[k] = tables[k].cache()
        st["table_rows"] = {k: v.count() for k, v in tables.items()}
        return FeaturePipelineModel(st, tables)


def _area_of(cabin):
    """Deck area of one cabin value (same rule as the column expression)."""
    if cabin is None:
        return UNKNOWN_AREA
    return T.CABIN_AREAS.get(str(cabin)[:1] or "U", UNKNOWN_AREA)


class FeaturePipelineModel:
    """Fitted state: plain scalars in ``state`` and class tables as
    DataFrames. ``save``/``load`` write JSON + Parquet."""

    def __init__(self, state: dict, tables: dict):
        self.state = state
        self.tables = tables

    def _codes(self, name: str):
        if f"codes_{name}" in self.state:
            return self.state[f"codes_{name}"]
        return self.tables.get(name)

    @property
    def feature_names(self) -> list[str]:
        return list(self.state.get("wanted", FEATURE_NAMES))

    def impute(self, df: DataFrame) -> DataFrame:
        r, st = self.state["roles"], self.state
        cols = {}
        for role in ("embarked", "cabin"):
            if r[role] in df.columns and st.get(f"mode_{role}") is not None:
                cols[r[role]] = F.coalesce(F.col(r[role]), F.lit(st[f"mode_{role}"]))
        for role in ("age", "fare"):
            if r[role] in df.columns and st.get(f"median_{role}") is not None:
                cols[r[role]] = F.coalesce(nan_to_null(r[role]), F.lit(float(st[f"median_{role}"])))
        if self.state.get("flag_before_impute") and r["cabin"] in df.columns:
            cols["__has_cabin"] = T.presence_flag(r["cabin"])
        return df.withColumns(cols) if cols else df

    def transform(self, df: DataFrame) -> DataFrame:
        r, st = self.state["roles"], self.state
        has = lambda role: r.get(role) in df.columns
        need = steps_of(self.feature_names)
        d = self.impute(df)
        imputed = d  # batch statistics are read from here, before any lookup join
        col = lambda role: F.col(r[role])
        pclass = col("pclass")
        fs = N.family_size(col("sibsp"), col("parch"))
        age = col("age") if has("age") else None
        fare = col("fare") if has("fare") else None
        # ticket frequency (W1) and prefix code
        if not has("ticket") or "ticket_frequency" not in need:
            d = d.withColumn("ticket_frequency", F.lit(1))
        elif st["bins"] == "fitted":
            tc = self.tables["ticket_counts"].select(
                F.col("value").alias(r["ticket"]), F.col("n").alias("ticket_frequency"))
            d = lookup_join(d, tc, r["ticket"], st["table_rows"].get("ticket_counts"))
            d = d.withColumn("ticket_frequency", F.coalesce("ticket_frequency", F.lit(1)))
        else:
            d = attach_counts(d, r["ticket"], "ticket_frequency")
        if has("ticket") and "ticket_prefix" in need:
            d = encode_with(d, T.ticket_prefix(r["ticket"]), self._codes("ticket_prefix"),
                            "ticket_prefix_code", fallback=OTHER_PREFIX)
        else:
            d = d.withColumn("ticket_prefix_code", F.lit(0))
        # deck area code, unseen area -> 'Unknown'
        if "deck" in need:
            area = T.cabin_area(T.first_letter(r["cabin"]) if has("cabin") else F.lit("U"))
            d = encode_with(d, area, self._codes("cabin_area"), "cabin_location_code",
                            fallback=UNKNOWN_AREA)
        else:
            d = d.withColumn("cabin_location_code", F.lit(0))
        # port code, unseen port -> fitted mode
        if has("embarked") and "port" in need and self._codes("port") is not None:
            port = F.coalesce(col("embarked"), F.lit(st["port_mode"]))
            d = encode_with(d, port, self._codes("port"), "embarked_code",
                            fallback=st["port_mode"])
        else:
            d = d.withColumn("embarked_code", F.lit(0))
        # quartile code of fare: edges of this batch (reference) or fitted
        if fare is not None and "fare_group" in need:
            edges = st.get("fare_edges") if st["bins"] == "fitted" else quantile_edges(imputed, r["fare"])
            edges_col = F.array(*[F.lit(float(e)) for e in edges]) if edges else \
                F.array().cast("array<double>")
            d = d.withColumn("fare_group", B.quantile_code(fare, edges_col))
        else:
            d = d.withColumn("fare_group", F.lit(None).cast("int"))

        sex = T.sex_code(col("sex")) if has("sex") else F.lit(0.5)
        title = (T.map_lookup(T.title(col("name")), st["title_codes"]) if has("name")
                 else F.lit(1))
        if has("cabin"):
            has_cabin = F.col("__has_cabin") if st.get("flag_before_impute") else T.presence_flag(r["cabin"])
            cabin_num = T.first_number(r["cabin"])
        else:
            has_cabin, cabin_num = F.lit(0), F.lit(None)
        cabin_num = F.coalesce(cabin_num, F.lit(st.get("median_cabin_number")).cast("double"),
                               F.lit(0.0))
        # an absent age or fare takes its fitted median, if both were fitted
        both = st.get("median_age") is not None and st.get("median_fare") is not None
        age_v = age if age is not None else F.lit(float(st["median_age"]) if both else 0.0)
        fare_v = fare if fare is not None else F.lit(float(st["median_fare"]) if both else 0.0)
        age_band = B.cut_left(age_v, B.AGE_BAND5_EDGES)
        alone = N.is_alone(fs)
        clc = F.col("cabin_location_code")
        emb = F.col("embarked_code")
        tf, tp = F.col("ticket_frequency"), F.col("ticket_prefix_code")
        P = N.product
        feats = {
            "pclass": pclass, "sibsp": col("sibsp"), "parch": col("parch"),
            "family_size": fs, "is_alone": alone,
            "family_type": B.cut_right(fs, B.FAMILY_TYPE_EDGES),
            "age_group": B.cut_right(age, B.AGE_GROUP_EDGES) if age is not None else F.lit(None),
            "age_x_class": age * pclass if age is not None else F.lit(None),
            "fare_group": F.col("fare_group"),
            "fare_x_class": fare * pclass if fare is not None else F.lit(None),
            "ticket_frequency": tf, "ticket_prefix_code": tp,
            "has_cabin": has_cabin, "cabin_location_code": clc, "cabin_number": cabin_num,
            "sex_code": sex, "embarked_code": emb, "title_code": title,
            "age": age_v, "fare": fare_v, "age_sq": age_v * age_v,
            "age_fare": age_v * fare_v, "fare_sq": fare_v * fare_v,
            "sex_x_class": P(sex, pclass), "age_band_x_sex": P(age_band, sex),
            "embarked_x_class": P(emb, pclass), "family_x_class": P(fs, pclass),
            "fare_x_cabin_location_code": P(fare_v, clc),
            "age_x_family_size": P(age_v, fs),
            "fare_per_person_x_class": P(N.guarded_ratio(fare_v, fs), pclass),
            "cabin_location_code_x_age_band": P(clc, age_band),
            "title_code_x_class": P(title, pclass),
            "loneliness_score": N.loneliness(alone, age_v),
            "ticket_frequency_x_class": P(tf, pclass),
            "ticket_prefix_code_x_class": P(tp, pclass),
            "fare_sq_x_sex_code": P(fare_v * fare_v, sex),
            "age_fare_x_sex_code": P(age_v * fare_v, sex),
        }
        keep = [F.col(r["id"])] if has("id") else []
        if has("label"):
            keep.append(F.col(r["label"]))
        return d.select(*keep, *[feats[f].cast("double").alias(f) for f in self.feature_names])

    # ---- persistence (S6) ----
    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        for k, t in self.tables.items():
            t.write.mode("overwrite").parquet(os.path.join(path, "tables", k))
        meta = spark.createDataFrame([(json.dumps(self.state),)], "state string")
        meta.coalesce(1).write.mode("overwrite").json(os.path.join(path, "state"))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "FeaturePipelineModel":
        state = json.loads(spark.read.json(os.path.join(path, "state")).first()["state"])
        tables = {k: spark.read.parquet(os.path.join(path, "tables", k)).cache()
                  for k in state["table_rows"]}
        return cls(state, tables)
