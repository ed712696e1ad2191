"""Byte-level BPE encoding and decoding.

Method. A text is cut into pre-tokens; the bytes of each are a doubly linked list of symbols, and a priority queue holds
the rank of every adjacent pair that can merge. The lowest rank, then the leftmost, merges first; an entry whose symbols
have changed since it was queued is stale and skipped. Decoding concatenates the vocabulary's strings and maps them back
to bytes. Each task keeps the ids of short pre-tokens it has seen, in a table of bounded size.

Ids are carried packed, little-endian unsigned 32-bit integers in a binary column; ``unpacked`` gives an array of longs.

Defined cases: a null text counts as empty; an empty text has no ids; the vocabulary's special tokens found in a text
become their own id, as the tokenizers library does by default. Texts of any length are encoded whole. Repeated rows
give equal rows, an empty table an empty result. A column that has the name of a result gives way to it; others pass through.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shutterlake.sources.tables import read_table

#: Pre-tokens kept by a worker, and the longest that is kept.
CACHED, LONGEST = 400_000, 48
#: Characters past a pre-token on which its end may depend, special tokens aside.
LOOKAHEAD = 16
#: No pair of symbols merges.
NEVER = np.int32(2**31 - 1)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Pieces:
    """Cuts texts into pre-tokens and counts or encodes them; one per task."""

    def __init__(self, model: str):
        from tokenizers.pre_tokenizers import ByteLevel

        data = json.loads(model)
        vocab = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        if any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in data["added_tokens"]):
            raise ValueError("special tokens that strip blanks or want whole words are not supported")
        #: Every special token starts with one of these, so a text without them needs no search.
        self.marks = sorted({x[:2] for x in self.special})
        #: How far before an edit a pre-token may end and still depend on it.
        self.context = max([LOOKAHEAD, *map(len, self.special)])
        self.letters = byte_letters()
        self.byte_ids = [vocab[c] for c in self.letters]
        merges = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
        self.ranks = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        to_byte = {c: b for b, c in enumerate(self.letters)}
        self.strings = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.strings[i] = bytes(to_byte[c] for c in token)
        for token, i in self.special.items():
            self.strings[i] = token.encode()
        # Letters, digits and blanks below U+0250 and in the punctuation blocks are the same in every version of Unicode, and
        # Python's own patterns are fast; a text with any other character is cut by the tokenizers library.
        import unicodedata

        known = "".join(map(chr, range(0x250)))
        letter, digit = (re.escape("".join(c for c in known if unicodedata.category(c)[0] == kind)) for kind in "LN")
        blank = r"\t-\r \x85\xa0 -     "
        self.fast = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{digit}]+| ?[^{blank}{letter}{digit}]+|[{blank}]+(?![^{blank}])|[{blank}]+")
        self.unknown = re.compile("[^\0-ɏ -⁮₠-₵]")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.slow = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
        self.packed: dict[str, bytes] = {}
        self.counted: dict[str, int] = {}
        # the same ranks as arrays: of pairs of bytes, and of all pairs sorted by first * size + second
        pairs = np.array(list(self.ranks), np.int64)
        self.radix = len(self.strings)
        keys = pairs[:, 0] * self.radix + pairs[:, 1] if len(pairs) else np.zeros(0, np.int64)
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        self.made = np.array([new for _, new in self.ranks.values()], np.int64)
        byte_ids = np.array(self.byte_ids, np.int64)
        self.byte_pairs = self.rank_of(np.repeat(byte_ids, 256), np.tile(byte_ids, 256)).reshape(256, 256)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, ``NEVER`` for those that don't merge or have a negative side."""
        if not len(self.pair_keys):
            return np.full(len(a), NEVER)
        keys = a * self.radix + b
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == keys) & (a >= 0) & (b >= 0), self.pair_ranks[at], NEVER)

    def split(self, text: str) -> list[str]:
        parts = self.cut.split(text) if any(m in text for m in self.marks) else [text]
        out: list[str] = []
        for part in parts:
            if part in self.special:
                out.append(part)
            elif self.unknown.search(part):
                out += [part[a:b] for _, (a, b) in self.slow(part)]
            else:
                out += self.fast.findall(part)
        return out

    def merged(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        if piece in self.special:
            return [self.special[piece]]
        ids = [self.byte_ids[b] for b in piece.encode()]
        n, ranks = len(ids), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(found[0], i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (found := ranks.get((a, b)))]
        heapq.heapify(queue)
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:  # stale
                continue
            ids[i], ids[j] = ranks[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := ranks.get((ids[i], ids[after[i]])):
                    heapq.heappush(queue, (found[0], i, ids[i], ids[after[i]]))
            if before[i] >= 0 and (found := ranks.get((ids[before[i]], ids[i]))):
                heapq.heappush(queue, (found[0], before[i], ids[before[i]], ids[i]))
        return [x for x in ids if x >= 0]

    def ids_of(self, piece: str) -> bytes:
        """Packed ids of one pre-token, remembered if it is short."""
        if (found := self.packed.get(piece)) is None:
            found = np.array(self.merged(piece), dtype="<u4").tobytes()
            if len(piece) <= LONGEST:
                if len(self.packed) >= CACHED:
                    self.packed.clear()
                self.packed[piece] = found
        return found

    def counts_of(self, pieces: list[str]) -> np.ndarray:
        """Tokens of each pre-token; those not yet known are counted together."""
        if len(self.counted) >= CACHED:
            self.counted.clear()
        fresh = list(set(pieces).difference(self.counted))
        short = [x for x in fresh if len(x) <= LONGEST and x not in self.special]
        self.counted.update(zip(short, self._counts(short).tolist(), strict=True))
        if len(short) == len(fresh):
            return np.fromiter(map(self.counted.__getitem__, pieces), np.uint32, len(pieces))
        long = {x: len(self.merged(x)) for x in fresh if len(x) > LONGEST or x in self.special}
        return np.fromiter((long[x] if x in long else self.counted[x] for x in pieces), np.uint32, len(pieces))

    def _counts(self, pieces: list[str]) -> np.ndarray:
        """Tokens of short pre-tokens, side by side: every round merges the lowest and then leftmost pair of each that still has one."""
        raw = [x.encode() for x in pieces]
        out = np.fromiter(map(len, raw), np.int64, len(raw))
        for at, rows in ((8, np.nonzero(out <= 8)[0]), (16, np.nonzero((out > 8) & (out <= 16))[0]), (4 * LONGEST, np.nonzero(out > 16)[0])):
            for begin in range(0, len(rows), (1 << 17) // at):
                own = rows[begin : begin + (1 << 17) // at]
                out[own] = self._side_by_side([raw[i] for i in own], int(out[own].max()))
        return out

    def _side_by_side(self, raw: list[bytes], width: int) -> np.ndarray:
        width += 2  # a place on either side that holds no symbol
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), np.uint8).reshape(-1, width)
        left = np.fromiter(map(len, raw), np.int64, len(raw))
        inside = np.arange(width)[None, :] < left[:, None]
        symbol = np.full((len(raw), width + 1), -1, np.int64)
        symbol[:, :width][inside] = np.array(self.byte_ids, np.int64)[data[inside]]
        rank = np.full((len(raw), width), NEVER)
        rank[:, :-1] = np.where(inside[:, 1:], self.byte_pairs[data[:, :-1], data[:, 1:]], NEVER)
        after = np.tile(np.minimum(np.arange(width + 1) + 1, width), (len(raw), 1))
        before = np.tile(np.arange(width + 1) - 1, (len(raw), 1))  # -1, the last place, holds no symbol
        rows = np.arange(len(raw))
        while len(rows):
            i = rank[rows].argmin(axis=1)
            lowest = rank[rows, i]
            more = lowest < NEVER
            rows, i, lowest = rows[more], i[more], lowest[more]
            j = after[rows, i]
            k, h = after[rows, j], before[rows, i]
            new = self.made[lowest]
            symbol[rows, i], symbol[rows, j] = new, -1
            rank[rows, j] = NEVER
            after[rows, i], before[rows, k] = k, i
            left[rows] -= 1
            rank[rows, i] = self.rank_of(new, symbol[rows, k])
            inner = h >= 0
            rank[rows[inner], h[inner]] = self.rank_of(symbol[rows, h][inner], new[inner])
        return left

    def each(self, pieces: list[str]) -> list[bytes]:
        """Packed ids of each pre-token; only those that are missing are merged."""
        known = list(map(self.packed.get, pieces))
        if None in known:
            known = [x if x is not None else self.ids_of(p) for x, p in zip(known, pieces, strict=True)]
        return known

    def encode(self, text: str | None) -> bytes:
        return b"".join(self.each(self.split(text or "")))

    def decode(self, packed: bytes | None) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(packed or b"", "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=1)
def pieces_of(model: str) -> Pieces:
    """The cutter of a vocabulary, kept by a Python worker from one task to the next with what it has counted."""
    return Pieces(model)


def broadcast_model(spark: SparkSession, path: str | None = None):
    """The tokenizer file (1.5 MB, whatever the data) as a broadcast variable."""
    with open(path or vocabulary_path(), encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


#: Rows of a batch that are encoded or decoded before they are passed on.
SLICE = 256


def mapped(df: DataFrame, added: dict[str, str], path: str | None, work: Callable) -> DataFrame:
    """``df`` with columns ``added`` (name: type) from ``work(pieces, slice)``, slice by slice in one Python process a task.

    A column of an added name gives way to the new one; the others pass through untouched.
    """
    model = broadcast_model(df.sparkSession, path)
    kept = [c for c in df.columns if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                new = dict(zip(added, work(pieces, part), strict=True))
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + list(new.values()), kept + list(new))

    schema = StructType([df.schema[c] for c in kept])
    schema = StructType(schema.fields + StructType.fromDDL(", ".join(f"{name} {kind}" for name, kind in added.items())).fields)
    return df.mapInArrow(run, schema)


def encoded(docs: DataFrame, text_col: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the packed ids of each text in column ``out``."""
    return mapped(docs, {out: "binary"}, path, lambda pieces, part: [pa.array(map(pieces.encode, part.column(text_col).to_pylist()), pa.binary())])


def decoded(df: DataFrame, ids_col: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """``df`` with the text of packed ids in column ``out``; bytes that are no UTF-8 become U+FFFD."""
    return mapped(df, {out: "string"}, path, lambda pieces, part: [pa.array(map(pieces.decode, part.column(ids_col).to_pylist()), pa.string())])


def round_trip(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` and ``decoded``, the text decoded from them."""

    def both(pieces: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        ids = list(map(pieces.encode, part.column(text_col).to_pylist()))
        return [pa.array(ids, pa.binary()), pa.array(map(pieces.decode, ids), pa.string())]

    return mapped(docs, {"ids": "binary", "decoded": "string"}, path, both)


def unpacked(ids: Column) -> Column:
    """Packed ids as an array of longs."""

    @F.pandas_udf("array<long>")
    def unpack(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: np.frombuffer(x or b"", "<u4").astype(np.int64))

    return unpack(ids)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = round_trip(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
