"""String column expressions (T1-T11, N11, J2). All are native Catalyst
expressions: no Python runs per row."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# These must equal the reference's for right results.
# Title word (text between a space and a dot in the name) -> title code.
TITLE_CODES = {
    "Mr": 1, "Miss": 2, "Mrs": 3, "Master": 4,
    "Dr": 5, "Rev": 5, "Col": 5, "Major": 5, "Mlle": 2,
    "Countess": 3, "Ms": 2, "Lady": 3, "Jonkheer": 1,
    "Don": 1, "Mme": 3, "Capt": 5, "Sir": 5,
}
# Titles kept as their own group when profiling; all others become 'Other'.
KEPT_TITLES = ("Mr", "Miss", "Mrs", "Master")
# First letter of the cabin -> deck area.
CABIN_AREAS = {
    "A": "Top_Deck", "B": "Top_Deck", "C": "Middle_Deck",
    "D": "Middle_Deck", "E": "Lower_Deck", "F": "Lower_Deck",
    "G": "Lower_Deck", "T": "Staff", "U": "Unknown",
}
# Sex -> code.
SEX_CODES = {"female": 0, "male": 1}
# One-letter ticket prefixes that are kept as they are.
KEPT_SHORT_PREFIXES = ("C", "S", "P")
# Patterns.
TITLE_PATTERN = r" ([A-Za-z]+)\."
FIRST_NUMBER_PATTERN = r"([0-9]+)"
# ---------------------------------------------------------------------------


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def map_lookup(c: Column | str, mapping: dict) -> Column:
    """Literal dictionary lookup; no match (or null key) -> null.
    The map literal is constant-folded by Catalyst."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(m, _c(c))


def first_capture(c: Column | str, pattern: str) -> Column:
    """First regex group; no match -> null (Spark alone would give '')."""
    return F.nullif(F.regexp_extract(_c(c), pattern, 1), F.lit(""))


def title(c: Column | str) -> Column:
    """Word between a space and a dot."""
    return first_capture(c, TITLE_PATTERN)


def title_code(c: Column | str) -> Column:
    """Title -> code 1..5, unknown -> null."""
    return map_lookup(title(c), TITLE_CODES)


def title_grouped(c: Column | str) -> Column:
    """Four titles kept, every other value (and null) -> 'Other'."""
    t = title(c)
    return F.when(t.isin(*KEPT_TITLES), t).otherwise(F.lit("Other"))


def ticket_prefix(c: Column | str) -> Column:
    """T4+T5: 'NONE' for an all-digit ticket; otherwise strip '.' and '/',
    trim, first space-separated token, upper case. A null ticket becomes
    'NAN' (the text of a missing value). Short prefixes other than C/S/P
    (including the empty one) -> 'OTHER'."""
    s = F.coalesce(_c(c).cast("string"), F.lit("nan"))
    raw = F.when(s.rlike(r"^[0-9]+$"), F.lit("NONE")).otherwise(
        F.upper(F.split(F.trim(F.translate(s, "./", "")), " ").getItem(0)))
    return F.when((F.length(raw) < 2) & ~raw.isin(*KEPT_SHORT_PREFIXES),
                  F.lit("OTHER")).otherwise(raw)


def first_letter(c: Column | str, missing: str = "U") -> Column:
    """First character, null -> 'U'."""
    return F.coalesce(F.substring(_c(c), 1, 1), F.lit(missing))


def cabin_area(letter: Column | str) -> Column:
    """Deck letter -> area, unknown -> 'Unknown'."""
    return F.coalesce(map_lookup(letter, CABIN_AREAS), F.lit("Unknown"))


def first_number(c: Column | str) -> Column:
    """First run of digits as a double; none -> null."""
    return first_capture(c, FIRST_NUMBER_PATTERN).try_cast("double")


def sex_code(c: Column | str) -> Column:
    """T9."""
    return map_lookup(c, SEX_CODES)


def presence_flag(c: Column | str) -> Column:
    """T10."""
    return _c(c).isNotNull().cast("int")


def text_null_marker(c: Column | str) -> Column:
    """The text 'NaN' (any case, padded) means missing."""
    c = _c(c)
    return F.when(F.upper(F.trim(c)) == F.lit("NAN"), F.lit(None)).otherwise(c)
