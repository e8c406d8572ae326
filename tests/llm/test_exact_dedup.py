from pyspark.sql import functions as F

from cohort.llm import exact_dedup

SCHEMA = "doc_id long, text string, h string, content_sha256 int"


def brute(rows):
    best, size = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        best[t] = i if best.get(t) is None else (best[t] if i is None else max(best[t], i))
    return sorted(((i, best[t or ""], size[t or ""], i == best[t or ""]) for i, t, *_ in rows),
                  key=repr)


ROWS = [(1, "a", "x", 1), (2, "a", "y", 2), (3, None, "z", 3), (4, "", None, 4),
        (5, "b " * 50_000, "q", 5), (6, "b " * 50_000, "q", None), (7, "ä\x00", "q", 0),
        (2, "a", "y", 2), (2, "c", "y", 2)]


def got(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=repr)


def test_matches_brute_force_with_nulls_ties_repeats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(exact_dedup.classify(df)) == brute(ROWS)


def test_colliding_hashes_are_told_apart_by_their_bytes(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    weak = lambda c: F.unhex(F.substring(F.md5(c.cast("binary")), 1, 0))
    assert got(exact_dedup.classify(df, hash_fn=weak)) == brute(ROWS)
    one = lambda c: F.unhex(F.lit("00"))
    assert got(exact_dedup.classify(df, hash_fn=one)) == brute(ROWS)


def test_deduplicate_keeps_one_row_per_text(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 2, 4, 6, 7]
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(df, keep="min").collect()) \
        == [1, 2, 3, 5, 7]


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.classify(empty).collect() == []
    assert exact_dedup.deduplicate(empty).collect() == []
    nulls = spark.createDataFrame([(None, "a"), (None, "a"), (None, "b"), (3, "b")],
                                  "doc_id long, text string")
    assert got(exact_dedup.classify(nulls)) == sorted(
        [(None, None, 2, True), (None, None, 2, True), (None, 3, 2, False), (3, 3, 2, True)],
        key=repr)
    assert exact_dedup.deduplicate(nulls).count() == 2


def test_deduplicate_with_columns_of_its_own_names(spark):
    df = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 3, 4), (3, "b", 5, 6)],
                               "doc_id long, text string, __k_sha int, __K_ID int")
    kept = exact_dedup.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted(map(tuple, kept.collect())) == [(2, "a", 3, 4), (3, "b", 5, 6)]
