from collections import defaultdict
from hashlib import sha256

from shutterlake.llm.exact_dedup import duplicate_rows, keep_one


def test_small_blocks_match_brute_force(spark):
    texts = ["", None, "a", "ab", "abcd", "abcdabcd", "abcdabcdabcdabcdabcde", "abcdabcdabcdabcdabcd", "abcdefgh", "efghabcd", "é" * 9, "A", " a", "x" * 5000, "x" * 5000, "x" * 4999]
    rows = [(i, t, i, "clash", b"") for i, t in enumerate(texts * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row long, local string, block binary").repartition(4)
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[t or ""].append(i)
    want = {(i, max(g), len(g), i == max(g), sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    assert {tuple(r)[1:] for r in duplicate_rows(df, block=4).collect()} == want


def test_nulls_repeats_large_ids_and_empty(spark):
    big = (1 << 60) + 1
    df = spark.createDataFrame([(None, "t"), (big, "t"), (big, "t"), (big - 1, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    got = duplicate_rows(df).collect()
    assert [r.keep_id for r in got if r.group_size == 4] == [big] * 4
    assert [r.keep_id for r in got if r.group_size == 2] == [None] * 2
    assert sorted((r.group_size, r.kept) for r in got) == [(2, False), (2, True), (4, False), (4, False), (4, False), (4, True)]
    assert duplicate_rows(df.limit(0)).count() == 0


def test_stage_keeps_one_row_and_all_columns(spark):
    df = spark.createDataFrame([(1, "t", "en"), (2, "t", "fr"), (2, "t", "fr"), (3, None, None), (4, "", "x")], "doc_id long, text string, lang string")
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "t", "fr"), (4, "", "x")]
