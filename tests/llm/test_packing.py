from zlib import crc32

import numpy as np
import pytest

from shutterlake.llm import packing
from shutterlake.llm.packing import Words, differencing, packed, padded, vocabulary_path, windows_of


@pytest.fixture(scope="module")
def words():
    with open(vocabulary_path(), encoding="utf-8") as f:
        return Words(f.read())


def check(found, lengths, window):
    """Pieces cover each document once; windows are gapless and within capacity. The share of padding is returned."""
    at = dict.fromkeys(range(len(lengths)), 0)
    for doc, start, length, *_ in sorted(map(tuple, found)):
        assert start == at[doc] and length > 0
        at[doc] += length
    assert list(at.values()) == list(lengths)
    ends = {}
    for _, _, length, w, offset in sorted(map(tuple, found), key=lambda x: (x[3], x[4])):
        assert offset == ends.get(w, 0)
        ends[w] = offset + length
    assert sorted(ends) == list(range(len(ends))) and max(ends.values()) <= window
    return sum(0 if x & (x - 1) == 0 else window - x for x in ends.values()) / sum(lengths)


@pytest.mark.parametrize("lengths", [[1], [5], [64], [63, 1], [64, 64], [200] * 3, [700] * 90, [33] * 41, [65] * 30, [1] * 1000, [10**4], [64 * 9]])
def test_awkward_lengths(lengths):
    assert check(windows_of(np.array(lengths), 64), lengths, 64) < 0.12


def test_padding_is_small_for_many_documents():
    rng = np.random.default_rng(1)
    lengths = np.minimum(rng.geometric(1 / 900, 1200), 60_000)
    assert check(windows_of(lengths), lengths.tolist(), packing.WINDOW) < 0.004


@pytest.mark.parametrize("ways", [1, 2, 3, 7])
def test_differencing(ways):
    sizes = np.random.default_rng(ways).integers(1, 500, 60)
    parts, sums = differencing(sizes, ways)
    assert [int(sizes[parts == p].sum()) for p in range(ways)] == sums.tolist()
    assert sums.max() - sums.min() <= 60


def test_differencing_merges_widest_spreads_first():
    parts, sums = differencing(np.array([8, 7, 6, 5, 4]), 2)  # the textbook case: a difference of two
    assert sorted(sums.tolist()) == [14, 16] and parts[0] != parts[1]


def test_ids_are_the_library_s(words):
    texts = ["", "It's we'll O'Neil's 'S 'twas ''s", "a1b22 c_d-e!!  x\t\ny\r z...", "ÀÉÎõü Straße ĲĳĿŀ Ŋŋſ ŉ İstanbul ıI", "x “quoted” — dash … ’s it’s", "<|endoftext|> a<|startoftext|>b <|", "á é b c\x85d\x1ce\x00f", "日本語 текст ٣٤ ½ ² ª", "µ × ÷ Σας ΣΑΣ", "A" * 300 + "!" * 200, "naïve　x"]
    for text in texts:
        assert np.frombuffer(words.encode(text), "<u4").tolist() == words.library.encode(text, add_special_tokens=False).ids, text


def test_operator(spark, words):
    texts = [None, "", "one two", "one two", "long words " * 9000, "ünï¢ode 日本 " * 50] + [f"text {i} " * (i % 37) for i in range(120)]
    rows = [(i if i != 1 else None, t, "x", 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, `offset` int").repartition(3)
    out = packed(docs).collect()
    ends, seen = {}, {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + len(r.ids) // 4
    for r in sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id, r.start)):
        assert r.start * 4 == len(seen.get(r.doc_id, b""))
        seen[r.doc_id] = seen.get(r.doc_id, b"") + r.ids
    want = {r[0]: np.array([*words.library.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4").tobytes() for r in rows}
    assert seen == want and max(ends.values()) <= packing.WINDOW
    assert all(r.doc_tokens * 4 == len(want[r.doc_id]) for r in out)
    assert sum(0 if x & (x - 1) == 0 else packing.WINDOW - x for x in ends.values()) < 0.01 * sum(ends.values())
    whole = {r.sequence_id: r for r in padded(packed(docs)).collect()}
    assert {k: sum(r.lengths) for k, r in whole.items()} == ends
    assert all(len(r.ids) // 4 == (n if n & (n - 1) == 0 else packing.WINDOW) for n, r in ((ends[k], r) for k, r in whole.items()))


def test_query_columns(spark, tmp_path, words):
    docs = [(i, f"some words {i} and it's more " * (i * 11 % 70)) for i in range(200)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: words.encode(t) + b"\2\0\0\0" for i, t in docs}
    rows = packing.op11_multiway_packing(spark, str(tmp_path)).collect()
    assert all(crc32(ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]) == r.ids_crc32 for r in rows)
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in ids.values())


def test_empty_and_bad_window(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packed(docs).collect() == [] and padded(packed(docs)).collect() == []
    with pytest.raises(ValueError):
        packed(docs, window=100)
