"""Packing token ids into fixed windows by multiway differencing.

Method. A task encodes its documents and packs them by groups of about ``GROUP`` tokens, so nothing is shuffled and no task holds more than a
group. In a group, pieces of a whole window are windows of their own. A tail is cut off that makes the rest come to just under a
whole number of windows; its tokens stand in windows whose lengths are powers of two, which need no padding. The rest is
partitioned by the largest differencing method of Karmarkar and Karp: every piece is a partial partition (its size and
zeros); the two with the widest spread merge, largest sum to smallest, until one is left, whose sums are near equal. If its largest
exceeds the window, the count of windows rises by one, and the method runs again. When that would leave over ``PADDING`` of the group as padding, the
longest pieces are cut in half and the count starts anew, so documents of an awkward length are packed as closely as others.
Pieces are an eighth of a window at most to begin with.

Ids are of the tokenizers library's word vocabulary. A pre-token's ids don't depend on what is around it, so a worker keeps the ids of those it has
seen, in a table of bounded size; texts with characters outside of Latin letters, ASCII and common quotes are cut and encoded by the library, as normal forms and
letter classes differ between versions of Unicode.

Defined cases: a null text counts as empty; a document of an empty text is its end id alone. Texts of any length are encoded whole, and one of more than
a window is cut. Repeated rows are documents of their own; a null ``doc_id`` stays null. An empty table gives an empty result; other
columns play no part. Windows are numbered by partition, so reruns over the same partitions agree.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.bpe import broadcast_model, byte_letters
from shutterlake.sources.tables import read_table

WINDOW, END = 4096, 2
#: Tokens of a group, at which it is packed; a group ends with a document.
GROUP = 256 * WINDOW
#: Documents are cut into pieces of at most this share of a window; whole ones would leave two per cent of padding.
SHARE = 8
#: Tokens a window is left short of on average, so that near-equal sums fit.
SLACK = 6
#: Share of a group that may be padding before pieces are cut further.
PADDING = 0.01
#: The tail's windows are of this many tokens at least, but in a group of less than a window.
LEAST = 64
#: Pre-tokens whose ids a worker keeps, and the longest that is kept.
CACHED, LONGEST = 400_000, 48


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Words(dict):
    """Packed ids (little-endian unsigned 32-bit) of lower-case pre-tokens, and of whole texts."""

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(model)
        self.library.no_truncation()
        self.library.no_padding()
        self.marks = [x.content for x in self.library.get_added_tokens_decoder().values()]
        # these are their own normal form, and lower-case alike in every version of Unicode
        self.unknown = re.compile("[^\t\n\r -~À-ÖØ-öø-įı-ňŊ-ž–—‘’“”…]")
        letters = "a-zß-öø-įı-ňŊ-ž"
        self.cut = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[0-9]|[^\t\n\r {letters}0-9]+").findall

        self.letters, self.tokens = byte_letters(), self.library.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        tokens = self.tokens(piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode())))
        ids = struct.pack(f"<{len(tokens)}I", *[x.id for x in tokens])
        if len(piece) <= LONGEST and len(self) < CACHED:
            self[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.unknown.search(text) or any(x in text for x in self.marks):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.__getitem__, self.cut(text.lower())))


@lru_cache(maxsize=1)
def words_of(model: str) -> Words:
    """The encoder of a vocabulary, kept by a Python worker from one task to the next."""
    return Words(model)


def differencing(sizes: np.ndarray, ways: int) -> tuple[np.ndarray, np.ndarray]:
    """The part of each of ``sizes``, and the sums of the ``ways`` parts, by the largest differencing method."""
    n = len(sizes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(ways, np.int64)
    held: dict[int, np.ndarray] = {}  # sums of a partial partition less its least, falling

    def sums(k: int) -> np.ndarray:
        if k >= n:
            return held.pop(k)
        leaf = np.zeros(ways, np.int64)
        leaf[0] = sizes[k]
        return leaf

    queue = [(-int(size), k) for k, size in enumerate(sizes)]
    heapq.heapify(queue)
    merges = []
    if ways > 1:
        while len(queue) > 1:
            (_, a), (_, b) = heapq.heappop(queue), heapq.heappop(queue)
            both = sums(a) + sums(b)[::-1]
            order = np.argsort(-both, kind="stable")
            both = both[order]
            new = n + len(merges)
            held[new] = both - both[-1]
            merges.append((a, b, order))
            heapq.heappush(queue, (-int(held[new][0]), new))
    # from the last merge back to the pieces: which part each place of a partial partition is
    parts = np.zeros(n, np.int64)
    places = {n + len(merges) - 1: np.arange(ways)}
    for k in range(len(merges) - 1, -1, -1):
        a, b, order = merges[k]
        whole = np.empty(ways, np.int64)
        whole[order] = places.pop(n + k)
        for child, own in ((a, whole), (b, whole[::-1])):
            if child < n:
                parts[child] = own[0]
            else:
                places[child] = own
    return parts, np.bincount(parts, weights=sizes, minlength=ways).astype(np.int64)


def _halved(pieces: np.ndarray, longest: int) -> np.ndarray:
    """``pieces`` (document, start, length), those over ``longest`` in equal parts of at most that."""
    times = -(-pieces[:, 2] // longest)
    doc, start, length, of = (np.repeat(x, times) for x in (*pieces.T, times))
    k = np.arange(len(doc)) - np.repeat(np.cumsum(times) - times, times)
    low, high = k * length // of, (k + 1) * length // of
    return np.stack([doc, start + low, high - low], axis=1)


def windows_of(lengths: np.ndarray, window: int = WINDOW, slack: int = SLACK) -> np.ndarray:
    """Pieces ``(document, start, length, window, offset)`` that pack documents of ``lengths`` tokens, with windows numbered from 0."""
    out, at = [], 0
    docs = np.arange(len(lengths))
    full = lengths // window
    if full.sum():  # whole windows of long documents
        doc = np.repeat(docs, full)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)
        out.append(np.stack([doc, k * window, np.full(len(doc), window), np.arange(len(doc)), np.zeros(len(doc), np.int64)], axis=1))
        at = len(doc)
    pieces = np.stack([docs, full * window, lengths - full * window], axis=1)
    pieces = pieces[pieces[:, 2] > 0]
    total = int(pieces[:, 2].sum())
    ways = total // window
    tail = total - ways * window + slack * ways
    if ways:
        tail = min(total, -(-tail // LEAST) * LEAST)
    if tail:  # windows of powers of two, from the last pieces on
        powers = [window] * (tail // window) + [1 << b for b in range(window.bit_length() - 1, -1, -1) if (tail % window) >> b & 1]
        while tail:
            doc, start, length = pieces[-1]
            take = min(int(length), tail)
            tail -= take
            pieces = pieces[:-1]
            if take < length:
                pieces = np.concatenate([pieces, [[doc, start, length - take]]])
                start += length - take
            room, fits = 0, []
            while take:  # the piece may go on over several windows
                if not powers[0]:
                    powers.pop(0)
                    at += 1
                fits.append((doc, start + room, min(take, powers[0]), at))
                room, take, powers[0] = room + fits[-1][2], take - fits[-1][2], powers[0] - fits[-1][2]
            out.append(np.array([(*f, -1) for f in fits], np.int64))
        at += 1
    total, longest = int(pieces[:, 2].sum()), max(1, window // SHARE)
    pieces = _halved(pieces, longest)
    while total:
        ways = -(-total // window)
        fair = ways
        while ways * window - total <= max(PADDING * total, (slack + 1) * fair + LEAST) or longest == 1:
            parts, sums = differencing(pieces[:, 2], ways)
            if sums.max() <= window:
                out.append(np.column_stack([pieces, parts + at, np.full(len(pieces), -1)]))
                total = 0
                break
            ways += 1
        else:
            longest //= 2
            pieces = _halved(pieces, longest)
    found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
    found = found[np.lexsort((found[:, 1], found[:, 0], found[:, 3]))]
    before = np.cumsum(found[:, 2]) - found[:, 2]
    first = np.concatenate([[True], found[1:, 3] != found[:-1, 3]]) if len(found) else np.zeros(0, bool)
    found[:, 4] = before - np.repeat(before[first], np.diff(np.append(np.nonzero(first)[0], len(found))))
    return found


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, path: str | None = None) -> DataFrame:
    """``(doc_id, start, ids, doc_tokens, sequence_id, offset)``: the pieces of each document, ``ids`` as packed unsigned 32-bit integers.

    ``window`` is a power of two. The pieces of a window stand one after the other, from offset 0 on.
    """
    if window < 1 or window & (window - 1):
        raise ValueError("a window is a power of two")
    model = broadcast_model(docs.sparkSession, path or vocabulary_path())
    names = [id_col, "start", "ids", "doc_tokens", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, stop = words_of(model.value), np.array([end], "<u4").tobytes()
        at = TaskContext.get().partitionId() << 33
        ids, held = [], []

        def group() -> pa.RecordBatch:
            nonlocal at, ids, held
            lengths = np.array([len(x) >> 2 for x in held], np.int64)
            found = windows_of(lengths, window)
            parts = [held[d][4 * s : 4 * (s + n)] for d, s, n in found[:, :3].tolist()]
            columns = [pa.array([ids[d] for d in found[:, 0]], kind), found[:, 1], pa.array(parts, pa.binary()), lengths[found[:, 0]], found[:, 3] + at, found[:, 4]]
            at += int(found[:, 3].max()) + 1
            ids, held = [], []
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], names)

        kind, size = None, 0
        for batch in batches:
            kind = batch.schema.field(0).type
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                held.append(words.encode(batch.column(1)[k].as_py()) + stop)
                size += len(held[-1]) >> 2
                if size >= GROUP:
                    yield group()
                    size = 0
        if held:
            yield group()

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, start long, ids binary, doc_tokens long, sequence_id long, offset long")


def padded(pieces: DataFrame, window: int = WINDOW, pad: int = 0) -> DataFrame:
    """``(sequence_id, ids, lengths)``: each window of ``packed`` as one binary of ids, padded to ``window`` unless its length is a power of two, with the lengths of its pieces."""
    whole = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))  # a window has at most `window` pieces
    joined = F.aggregate("parts", F.lit(b""), lambda s, x: F.concat(s, x["ids"]))
    n = F.length("joined") / 4
    short = F.when(F.bit_count(n.cast("long")) != 1, F.expr(f"unhex(repeat('{pad.to_bytes(4, 'little').hex()}', cast({window} - length(joined) / 4 as int)))")).otherwise(F.lit(b""))
    return whole.withColumn("joined", joined).select("sequence_id", F.concat("joined", short).alias("ids"), F.transform("parts", lambda x: (F.length(x["ids"]) / 4).cast("int")).alias("lengths"))


def op11_multiway_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packed(read_table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
