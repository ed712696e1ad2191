"""Katz backoff scoring with Good-Turing discounts over n-grams up to an order.

Method. P(w | h) = d_c c(h w) / c(h) if the n-gram was seen c times in training, else a(h) P(w | h') with h' the history without its first word; at the
end of the recursion P(w) backs off from the discounted count of w to the mass of words never seen, which stand together as one more word. Counts
up to ``CUTOFF`` are discounted by Good-Turing, order by order (where their counts of counts don't allow it, by a half of one);
a(h) = (1 - sum of P(w | h) over seen) / (1 - sum of P(w | h') over seen), so that each distribution sums to one. A history of which every count is
above the cutoff gives up 1 / (c(h) + 1) instead. A text is scored from a start mark to its end mark, which counts as a token.

Layout. Texts become blocks of word numbers in a table of the shared folder. Order by order, a block asks for each of its distinct words, bigrams and
so on once: its keys go, packed and partitioned by hash, to the partition of that order's table, which merges the counts of all blocks, and the merged
counts come back to the block; with the probabilities of one order a block can ask for the next. Only counts of counts, a few numbers an order, pass
through the driver. A history with more than its share of tokens is spread over all partitions by the following word; its sums are added up
afterwards and joined to the blocks that ask for it, so no partition depends on how frequent one word is.

Words are known by their XXH64 number (seed 42), histories of three words on by a 64-bit hash. Of n different ones two are taken for one with a chance
of about n^2 / 2^65: 3e-6 for 10 million, 3 % for a billion; their counts then merge, and nothing else changes. The vocabulary may hold 2^32 - 3 words; one
that is larger is an error. Counts are 64 bits wide throughout.

Defined cases: a null text counts as empty, which is one end mark. With nothing to learn from, the one unseen word has probability 1. Texts of any length are
taken whole. Rows with a null or repeated id are rows of their own; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shutterlake.session import written
from shutterlake.sources.tables import read_table

CUTOFF, ORDER = 5, 2
#: Characters of text in a block, but for a longer single text; words a task remembers; tokens for each partition of a table.
BLOCK, CACHED, SHARE = 12_000_000, 50_000, 2_000_000
#: Occurrences below which no history is spread over partitions.
HOT = 1000
#: Marks among word numbers: the start of a text, and a word not seen in training.
START, UNSEEN = 2**32 - 1, 2**32 - 2


def pack(a: np.ndarray) -> bytes:
    """An array by byte planes, compressed: the high bytes of small numbers take next to nothing."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.itemsize).T.tobytes() if len(a) else b"")


def unpack(data: bytes, dtype: str) -> np.ndarray:
    import zstandard

    raw, size = zstandard.ZstdDecompressor().decompress(data), np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(dtype).ravel() if raw else np.zeros(0, dtype)


def mixed_bits(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of 64-bit keys (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def good_turing(n: list[int], cutoff: int = CUTOFF) -> np.ndarray:
    """Discounts d_0..d_{cutoff+1} from counts of counts n[1..cutoff+1] (n[0] unused); the last is 1 and holds for all above."""
    for k in range(cutoff, 0, -1):
        if all(n[r] > 0 for r in range(1, k + 2)):
            common = (k + 1) * n[k + 1] / n[1]
            if common < 1:
                d = [((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common) for r in range(1, k + 1)]
                if all(0 < x < 1 for x in d):
                    return np.array([0.0, *d, *[1.0] * (cutoff + 1 - k)])
    return np.array([0.0, *[(r - 0.5) / r for r in range(1, cutoff + 1)], 1.0])


@dataclass
class Unigrams:
    """P(w) by count: what the driver knows of the unigram table."""

    total: int
    words: int
    discounts: np.ndarray
    unseen: float
    scale: float

    @staticmethod
    def of(total: int, words: int, n: list[int]) -> Unigrams:
        d = good_turing(n)
        given = sum((1 - d[r]) * r * n[r] for r in range(1, CUTOFF + 1))
        if not total:
            return Unigrams(0, 0, d, 1.0, 1.0)
        return Unigrams(total, words, d, given / total, 1.0) if given > 0 else Unigrams(total, words, d, 1 / (total + 1), total / (total + 1))

    def p(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts == 0, self.unseen, self.scale * self.discounts[np.minimum(counts, CUTOFF + 1)] * counts / max(1, self.total))


def _blocks(docs: DataFrame) -> DataFrame:
    """Texts as local word numbers: ``words`` are the sorted distinct words of a block, ``counts`` how often they occur in its training texts."""

    def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        known: dict[bytes, int] = {}

        def number(word: bytes) -> int:
            if (x := known.get(word)) is None:
                if len(known) >= CACHED:
                    known.clear()
                x = known[word] = xxh64_intdigest(word, 42)
            return x

        end = np.array([xxh64_intdigest(b"\n", 42)], np.uint64)  # no word holds a line feed
        name, held, size = TaskContext.get().partitionId() << 33, [], 0

        def whole() -> pa.RecordBatch:
            lengths = np.array([len(x) for _, _, x in held])
            train = np.array([t for _, t, _ in held], np.uint8)
            tokens = np.concatenate([x for _, _, x in held])
            words = np.unique(tokens)
            local = np.searchsorted(words, tokens).astype(np.uint32)
            counts = np.bincount(local[np.repeat(train, lengths) > 0], minlength=len(words))
            known_id = np.array([i is not None for i, _, _ in held], np.uint8)
            ids = np.array([int(i or 0) for i, _, _ in held], np.int64)
            arrays = {"ids": ids, "known": known_id, "train": train, "lengths": lengths.astype(np.uint32), "local": local, "words": words, "counts": counts.astype(np.uint32)}
            return pa.RecordBatch.from_pydict({"block": pa.array([name], pa.int64()), "tokens": pa.array([len(local)], pa.int64())} | {k: pa.array([pack(v)], pa.binary()) for k, v in arrays.items()})

        for batch in batches:  # a text at a time becomes Python's
            for doc_id, learns, text in zip(*(batch.column(c) for c in ("id", "learns", "text")), strict=True):
                doc_id, learns, text = doc_id.as_py(), learns.as_py(), text.as_py()
                words = (text or "").encode().lower().split()
                held.append((doc_id, learns, np.append(np.fromiter(map(number, words), np.uint64, len(words)), end)))
                size += len(text or "")
                if size >= BLOCK:
                    yield whole()
                    name, held, size = name + 1, [], 0
        if held:
            yield whole()

    return docs.mapInArrow(block, "block long, tokens long, ids binary, known binary, train binary, lengths binary, local binary, words binary, counts binary")


def _merge_words(blocks: DataFrame, bits: int) -> DataFrame:
    """The unigram table, a row for each partition with ``block`` null, and what each partition says to each block: word numbers within the partition, and counts."""

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for frame in frames:
            for r in frame.itertuples():
                words, counts = unpack(r.words, "<u8"), unpack(r.counts, "<u4")
                ends = [0, *np.searchsorted(words, edges).tolist(), len(words)]
                yield pd.DataFrame([(b, r.block, pack(words[x:y]), pack(counts[x:y])) for b, (x, y) in enumerate(zip(ends, ends[1:], strict=False)) if y > x], columns=["part", "block", "words", "counts"])

    def merge(asked: pd.DataFrame) -> pd.DataFrame:
        words, counts = [unpack(x, "<u8") for x in asked["words"]], [unpack(x, "<u4") for x in asked["counts"]]
        all_words, place = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts), len(all_words)).astype(np.uint64)
        own = np.where(total > 0, np.cumsum(total > 0) - 1, UNSEEN).astype(np.uint32)
        ends = np.cumsum([0, *map(len, words)])
        part, seen = asked["part"].iloc[0], total[total > 0]
        rows = [(part, block, pack(own[place[x:y]]), pack(total[place[x:y]]), None, None) for block, x, y in zip(asked["block"], ends, ends[1:], strict=False)]
        n = np.bincount(np.minimum(seen, CUTOFF + 2).astype(np.int64), minlength=CUTOFF + 3)[: CUTOFF + 2]
        rows.append((part, None, pack(all_words[total > 0]), pack(seen), int(seen.sum()), [len(seen), *n[1:].tolist()]))
        out = pd.DataFrame(rows, columns=["part", "block", "a", "b", "total", "n"])
        return out.astype({"block": "Int64", "total": "Int64"})

    asked = blocks.select("block", "words", "counts").mapInPandas(ask, "part int, block long, words binary, counts binary")
    return written(asked.groupBy("part").applyInPandas(merge, "part int, block long, a binary, b binary, total long, n array<long>"), "unigrams")


class Block:
    """A block with the numbers and counts of its words, and of each order that has been answered the probability of every token."""

    def __init__(self, row, answers: pd.DataFrame, unigrams: Unigrams, starts: int, hot: int, bits: int):
        answers = answers[answers["level"] == 1].sort_values("part")
        own = [unpack(x, "<u4").astype(np.uint64) for x in answers["a"]]
        number = np.concatenate([np.where(x == UNSEEN, np.uint64(UNSEEN), x + np.uint64(at)) for at, x in zip(answers["offset"], own, strict=True)])
        count = np.concatenate([unpack(x, "<u8") for x in answers["b"]]).astype(np.int64)
        local = unpack(row.local, "<u4")
        self.starts, self.hot_from, self.bits = starts, hot, bits
        self.lengths = unpack(row.lengths, "<u4").astype(np.int64)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(unpack(row.train, "u1"), self.lengths)
        self.words, self.count = number[local], count[local]
        self.p = unigrams.p(self.count)
        self.prior, self.seen, self.head = self.count.astype(np.uint64), self.count, np.zeros(len(local), np.uint64)
        self.level = 1

    def ask(self) -> None:
        """Goes to the next order: the history of each token, how often it was seen, and the distinct n-grams by partition."""
        # a history is the one of the token before and that token
        head = self.words if self.level == 1 else mixed_bits(mixed_bits(self.head) + self.words)
        self.head, self.h_count = np.roll(head, 1), np.roll(self.seen, 1)
        self.head[self.first], self.h_count[self.first] = START, self.starts
        self.level += 1
        self.asks = self.h_count > 0
        heads, of = np.unique(self.head[self.asks], return_inverse=True)
        _, at, self.place = np.unique((of.astype(np.uint64) << np.uint64(32)) | self.words[self.asks], return_index=True, return_inverse=True)
        at = np.nonzero(self.asks)[0][at]
        self.key_head, self.key_word, self.key_prior, self.key_h_count = self.head[at], self.words[at].astype(np.uint32), self.prior[at], self.h_count[at]
        self.train_counts = np.bincount(self.place, self.train[self.asks], len(at)).astype(np.uint32)
        self.hot = self.key_h_count >= self.hot_from
        spread = np.where(self.hot, mixed_bits(self.key_head) + self.key_word.astype(np.uint64), self.key_head)
        part = (mixed_bits(spread) >> np.uint64(64 - self.bits)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        parts, begins = np.unique(part[order], return_index=True)
        self.slices = {int(p): order[x:y] for p, x, y in zip(parts, begins, [*begins[1:], len(order)], strict=False)}

    def take(self, answers: pd.DataFrame, discounts: np.ndarray) -> None:
        """The counts of the order asked for, and with them the probability of every token."""
        answers = answers[answers["level"] == self.level]
        sums = {x["h"]: (x["n"], x["mass"]) for found in answers["sums"] if found is not None for x in found}
        n = len(self.key_head)
        seen, alpha, scale = np.zeros(n, np.int64), np.ones(n), np.ones(n)
        for x in answers.itertuples():
            if x.a is None:
                continue
            i = self.slices[x.part]
            seen[i] = unpack(x.a, "<u8")
            heads, at, of = np.unique(self.key_head[i], return_index=True, return_inverse=True)
            n_r, mass = unpack(x.b, "<u4").reshape(CUTOFF, -1).astype(np.float64), unpack(x.c, "<f8").copy()
            for k in np.nonzero(self.hot[i][at])[0]:  # what this partition has of a hot history gives way to its sums over all
                n_r[:, k], mass[k] = sums[int(heads[k].view(np.int64))]
            alpha[i], scale[i] = backoff(discounts, n_r[:, of], mass[of], self.key_h_count[i])
        own = scale * discounts[np.minimum(seen, CUTOFF + 1)] * seen / np.maximum(self.key_h_count, 1)
        self.seen = np.zeros(len(self.p), np.int64)
        self.seen[self.asks] = seen[self.place]
        # a history that training never saw leaves the probability of the order below
        self.p[self.asks] = np.where(seen[self.place] > 0, own[self.place], alpha[self.place] * self.p[self.asks])
        self.prior = self.p.view(np.uint64).copy()


def backoff(discounts: np.ndarray, n_r: np.ndarray, mass: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a(h), and the factor of seen probabilities of each history."""
    left = sum((1 - discounts[r]) * r * n_r[r - 1] for r in range(1, CUTOFF + 1)) / np.maximum(counts, 1)
    none = left <= 0
    left = np.where(none, 1 / (counts + 1), left)
    return left / (1 - mass), np.where(none, counts / (counts + 1), 1.0)


def _merge_grams(requests: DataFrame, level: int, unigrams: Unigrams) -> DataFrame:
    """The table of an order (``block`` null: heads, words and counts), and for each block the counts of its n-grams, and n_1..n_CUTOFF and the sum of lower probabilities over seen words of its histories."""

    def merge(asked: pd.DataFrame) -> pd.DataFrame:
        heads, words = [unpack(x, "<u8") for x in asked["heads"]], [unpack(x, "<u4") for x in asked["words"]]
        all_heads, of = np.unique(np.concatenate(heads), return_inverse=True)
        keys = (of.astype(np.uint64) << np.uint64(32)) | np.concatenate(words)
        all_keys, at, place = np.unique(keys, return_index=True, return_inverse=True)
        total = np.bincount(place, np.concatenate([unpack(x, "<u4") for x in asked["train"]]), len(all_keys)).astype(np.int64)
        prior = np.concatenate([unpack(x, "<u8") for x in asked["prior"]])[at]
        # below the second order a probability follows from the word's count, which takes fewer bytes
        p = np.where(total > 0, unigrams.p(prior.astype(np.int64)) if level == 2 else prior.view(np.float64), 0)
        own = (all_keys >> np.uint64(32)).astype(np.int64)
        mass = np.bincount(own, p, len(all_heads))
        n = np.stack([np.bincount(own, total == r, len(all_heads)) for r in range(1, CUTOFF + 1)]).astype(np.uint32)
        ends, part, rows = np.cumsum([0, *map(len, heads)]), asked["part"].iloc[0], []
        for block, mine, hot, x, y in zip(asked["block"], heads, asked["hot"], ends, ends[1:], strict=False):
            asked_heads = np.searchsorted(all_heads, np.unique(mine))
            rows.append((part, block, pack(total[place[x:y]].astype(np.uint64)), pack(n[:, asked_heads].ravel()), pack(mass[asked_heads]), None, None, unpack(hot, "<i8").tolist()))
        hot = np.unique(np.concatenate([unpack(x, "<u8") for x in asked["hot"]]))
        sums = [{"h": int(h.view(np.int64)), "n": n[:, k].astype(float).tolist(), "mass": float(mass[k])} for h, k in zip(hot, np.searchsorted(all_heads, hot), strict=True)]
        seen = total > 0
        counts = np.bincount(np.minimum(total, CUTOFF + 2), minlength=CUTOFF + 3)[: CUTOFF + 2]
        rows.append((part, None, pack(all_heads[own[seen]]), pack((all_keys[seen] & np.uint64(0xFFFFFFFF)).astype(np.uint32)), pack(total[seen].astype(np.uint64)), [0, *counts[1:].tolist()], sums, None))
        return pd.DataFrame(rows, columns=["part", "block", "a", "b", "c", "n", "sums", "asks"]).astype({"block": "Int64"})

    schema = "part int, block long, a binary, b binary, c binary, n array<long>, sums array<struct<h:long,n:array<double>,mass:double>>, asks array<long>"
    return written(requests.groupBy("part").applyInPandas(merge, schema), f"grams-{level}")


#: What is told to a block: level 1 its words' numbers within a partition (a), where those start (offset) and counts (b); above, counts (a), n_r (b) and mass (c), and sums of hot histories.
TOLD = "block long, part int, level int, offset long, a binary, b binary, c binary, sums array<struct<h:long,n:array<double>,mass:double>>"


def _told(df: DataFrame, level: int, **columns: Column) -> DataFrame:
    """``df`` in the columns of ``TOLD``."""
    given = {"block": F.col("block"), "part": F.lit(-1), "level": F.lit(level)} | columns
    return df.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(TOLD).fields])


def katz_scores(docs: DataFrame, learns: Column, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Scores of every row; and the tables of the model, a row for each partition: of words (a: XXH64 numbers, b: counts) and of each order from two on (a: heads, b: words, c: counts)."""
    source = docs.select(F.col(id_col).cast("string").alias("id"), learns.alias("learns"), F.col(text_col).alias("text"))
    blocks = written(_blocks(source), "blocks")
    tokens = blocks.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    bits = max(5, int(tokens // SHARE).bit_length())
    words = _merge_words(blocks, bits)
    table = words.filter("block is null")
    total, n_words, *n = (x or 0 for x in table.agg(F.sum("total"), *[F.sum(F.col("n")[r]) for r in range(CUTOFF + 2)]).first())
    if n_words >= UNSEEN:
        raise ValueError("more words than word numbers")
    unigrams = Unigrams.of(total, n_words, [0, *n])
    before = F.coalesce(F.sum(F.col("n")[0]).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a partition
    told = words.filter("block is not null").join(table.select("part", before.alias("offset")), "part")
    told = _told(told, 1, part=F.col("part"), offset=F.col("offset"), a=F.col("a"), b=F.col("b"))
    starts = docs.filter(learns).count()
    hot = max(HOT, total >> (bits + 3))  # so at most 8 hot histories for each partition
    texts, discounts, tables = blocks.select("block", "ids", "known", "train", "lengths", "local"), [], []

    def reached(r, answers: pd.DataFrame, levels: list[np.ndarray]) -> Block:
        b = Block(r, answers, unigrams, starts, hot, bits)
        for d in levels:
            b.ask()
            b.take(answers, d)
        return b

    def requests(levels: list[np.ndarray]):
        def request(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
            out = []
            for r in rows.itertuples():
                b = reached(r, answers, levels)
                b.ask()
                for part, i in b.slices.items():
                    out.append((part, r.block, pack(b.key_head[i]), pack(b.key_word[i]), pack(b.train_counts[i]), pack(b.key_prior[i]), pack(np.unique(b.key_head[i][b.hot[i]]))))
            return pd.DataFrame(out, columns=["part", "block", "heads", "words", "train", "prior", "hot"])

        schema = "part int, block long, heads binary, words binary, train binary, prior binary, hot binary"
        return texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(request, schema)

    for level in range(2, order + 1):
        grams = _merge_grams(requests(list(discounts)), level, unigrams)
        table_k, said = grams.filter("block is null"), grams.filter("block is not null")
        tables.append(table_k.select("part", "a", "b", "c"))
        n = table_k.agg(*[F.coalesce(F.sum(F.col("n")[r]), F.lit(0)) for r in range(1, CUTOFF + 2)]).first()
        discounts.append(good_turing([0, *n]))
        parts = table_k.select(F.explode("sums").alias("x")).select("x.h", "x.n", "x.mass")
        sums = parts.groupBy("h").agg(F.array(*[F.sum(F.col("n")[r]) for r in range(CUTOFF)]).alias("n"), F.sum("mass").alias("mass"))
        wanted = said.select("block", F.explode("asks").alias("h")).distinct().join(sums, "h")
        wanted = wanted.groupBy("block").agg(F.collect_list(F.struct("h", "n", "mass")).alias("sums"))  # of the words of a block
        told = told.unionByName(_told(said, level, part=F.col("part"), a=F.col("a"), b=F.col("b"), c=F.col("c"))).unionByName(_told(wanted, level, sums=F.col("sums")))
    levels = list(discounts)

    def score(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.itertuples():
            b = reached(r, answers, levels)
            base = np.log10((b.count + 0.5) / (total + 0.5 * (n_words + 1)))
            known = unpack(r.known, "u1") > 0
            ids = pd.array(unpack(r.ids, "<i8"), dtype="Int64")
            ids[~known] = pd.NA
            add = lambda v: np.add.reduceat(v, b.first)
            out.append(pd.DataFrame({"doc_id": ids, "held_out": unpack(r.train, "u1") == 0, "n_tokens": b.lengths, "n_known": add((b.count > 0).astype(np.int64)), "train_tokens": total, "base_score": add(base), "score": add(np.log10(b.p))}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    scored = texts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("doc_id", id_col), table.select("part", "a", "b"), tables


def held_out_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def op2_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return katz_scores(docs, ~held_out_of(F.col("doc_id")))[0]
