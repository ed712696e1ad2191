"""SimHash near-duplicate detection with pivot distance tables.

Method. Each text gets a 64-bit fingerprint; from here on only distinct fingerprints matter, so copies cost one row.
1. Blocking without loss: the 64 bits are cut into six blocks. Two fingerprints that differ in three bits or fewer
   agree on at least three whole blocks, so they share one of the 20 keys made of three blocks.
2. Pivot distance table: for every fingerprint that shares a key, its Hamming distances to ``PIVOTS`` reference
   fingerprints. By the triangle inequality |d(x, p) - d(y, p)| <= d(x, y), so a pair whose largest coordinate
   difference is over the radius is discarded.
3. Survivors are verified by their exact distance; each unit of work gives a spanning forest of its links rather than
   all its pairs, and the forest edges go to distributed connected components.
A key with many fingerprints is cut into chunks by hash; every pair of chunks is a unit of work of its own, so no task
ever holds more than two chunks and no pair is lost.

The pipeline's stage (``keep_one``) has another rule, exact Jaccard of 5-word shingles of 0.8 or more, at which two whole texts differ in about 10
of 64 bits, too many for blocks. It takes several fingerprints of a text instead of one: the SimHash of each of ``SAMPLES`` samples of ``DRAWS``
shingles, drawn alike from every text (least hashes). A sample that differs in one shingle is already about 12 bits away, so their radius is 0 and the
only block is the fingerprint itself: texts are candidates if a sample of theirs has the same fingerprint. Candidates have a pivot distance table in
the rule's own distance (shingles that only one of two sets has): the reference sets are ``PARTS`` parts of the hash space, a set's distance to one
follows from its size and its shingles there, and pairs that differ there by more than the rule allows are discarded without loss. The rest are
verified by their sets of 64-bit shingle hashes.

Defined cases: a null text counts as empty; a text with no words has fingerprint 0 and links like any other; a text with
fewer words than a shingle is one shingle. Rows with a null id are returned, but a null is never the least id (a
component of nulls alone has a null id). Repeated rows are returned as often as they occur. Other columns, whatever
their names, play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.names import free_name, own_columns
from shutterlake.operators.components import connected_components
from shutterlake.session import cut, written
from shutterlake.sources.tables import read_table

#: (first bit, bits) of the six blocks; three of them are a key.
BLOCKS = ((0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10))
RADIUS = 3
PIVOTS = 16
#: Fingerprints of one key that a unit of work takes from each of its two chunks.
CHUNK = 2048
#: The stage's rule: words of a shingle, and the Jaccard of two texts' shingles (4 of 5) from which on they are near copies.
WIDTH, LIKENESS = 5, (4, 5)
#: Sampled fingerprints of a text, and shingles drawn for each: a pair at the rule's edge shares one with a chance of 1 - (1 - 0.8^5)^20 = 0.9996.
SAMPLES, DRAWS = 20, 5
#: Parts of the hash space in which shingles are counted, and texts that a unit takes from each of its chunks.
PARTS, UNIT = 64, 512


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def pivots(n: int = PIVOTS) -> list[int]:
    """``n`` reference fingerprints as signed longs, from the odd multiples of the golden ratio's 64-bit fraction."""
    return [_signed((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for i in range(n)]


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of ``hashes`` have each of the 64 bits set; of several rows of hashes, for each row."""
    return np.unpackbits(hashes.view(np.uint8).reshape(*hashes.shape, 8), axis=-1, bitorder="little").sum(-2, dtype=np.int64)


def _majority(ones: np.ndarray, total: int) -> np.ndarray:
    """The fingerprints, as signed longs, with the bits that are set in over half of ``total`` hashes."""
    return np.packbits(2 * ones > total, axis=-1, bitorder="little").view(np.int64).ravel()


def simhash_udf(width: int = 3) -> Column:
    """A pandas UDF from text to its fingerprint as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        from xxhash import xxh64_intdigest

        def of(text: str | None) -> int:
            words = (text or "").encode().lower().split()  # bytes: only A-Z, only ASCII white space
            if not words:
                return 0
            shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)])
            total, ones = 0, np.zeros(64, np.int64)
            while len(h := np.fromiter((xxh64_intdigest(s, 42) for s in islice(shingles, 65536)), np.uint64)):
                total += len(h)
                ones += _ones(h)
            return int(_majority(ones, total)[0])

        return pd.Series([of(x) for x in texts], dtype="int64")

    return simhash


def _unit_links(fp: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of one unit; ``table``: a row of pivot distances for each."""
    fp, first = np.unique(fp, return_index=True)
    order = np.argsort(table[first, 0], kind="stable")
    fp, table = fp[order], table[first][order].astype(np.int16)
    ends = np.searchsorted(table[:, 0], table[:, 0] + radius, side="right")  # within the radius on the first pivot
    parent = list(range(len(fp)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    bits = fp.view(np.uint64)
    step = max(1, (1 << 21) // max(1, len(fp)))
    for at in range(0, len(fp), step):
        rows = np.arange(at, min(at + step, len(fp)))
        n = ends[rows] - rows - 1
        i = np.repeat(rows, n)
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + i + 1
        for k in range(1, table.shape[1]):  # discard by the other coordinates, one after the other
            near = np.abs(table[i, k] - table[j, k]) <= radius
            i, j = i[near], j[near]
        real = np.bitwise_count(bits[i] ^ bits[j]) <= radius
        for a, b in zip(i[real].tolist(), j[real].tolist(), strict=True):
            if (x := root(a)) != (y := root(b)):
                parent[max(x, y)] = min(x, y)
                links.append((int(fp[a]), int(fp[b])))
    return links


def fingerprint_links(prints: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """``(src, dst)``: links among the distinct longs in ``prints(fp)`` that connect all that differ in ``radius`` bits or fewer.

    ``radius`` is 3 at most, as the blocking needs. Links are those of spanning forests: two fingerprints within the
    radius are connected by them, though not always directly.
    """
    if not 0 <= radius <= 3:
        raise ValueError("the blocks hold for a radius of 0 to 3")
    fp = F.col("fp")
    keys = []
    for k, own in enumerate(combinations(range(len(BLOCKS)), 3)):
        mask = sum(((1 << BLOCKS[b][1]) - 1) << BLOCKS[b][0] for b in own)
        keys.append(F.xxhash64(F.lit(k), fp.bitwiseAND(F.lit(_signed(mask)))))  # a hash that collides only adds pairs to verify
    keyed = cut(prints.select("fp").distinct().select("fp", F.explode(F.array(*keys)).alias("key")))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    rows = keyed.join(shared, "key").withColumn("chunks", F.ceil(F.col("n") / chunk)).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("chunks")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("other")
    units = rows.select("key", "fp", "own", other).select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "fp")
    table = F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))) for p in pivots()])
    units = units.withColumn("distances", table).repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: pd.DataFrame | None = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            unit = held[["key", "lo", "hi"]].to_numpy()
            starts = np.concatenate([[0], np.nonzero((unit[1:] != unit[:-1]).any(axis=1))[0] + 1]) if len(unit) else np.array([0])
            yield links_of(held, starts)
            held = held.iloc[starts[-1] :]  # the last unit may go on in the next frame
        if held is not None and len(held):
            yield links_of(held, np.array([0, len(held)]))

    def links_of(frame: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        fp, table = frame["fp"].to_numpy(np.int64), frame["distances"].to_numpy()
        found = [x for a, b in zip(starts[:-1], starts[1:], strict=True) for x in _unit_links(fp[a:b], np.vstack(table[a:b]), radius)]
        return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

    return units.mapInPandas(link, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, radius: int = RADIUS) -> DataFrame:
    """``(id_col, fingerprint, component_id)`` for every row of ``docs``: 16 hex digits and the least id reachable."""
    marked = cut(docs.select(F.col(id_col).alias("id"), simhash_udf(width)(F.col(text_col)).alias("fp")))
    prints = cut(marked.groupBy("fp").agg(F.min("id").alias("first_id")))
    parts = cut(connected_components(fingerprint_links(prints, radius)))
    linked = prints.join(parts, prints.fp == parts.node).select("fp", "first_id", "component")
    least = linked.groupBy("component").agg(F.min("first_id").alias("least_id"))
    named = linked.join(least, "component").select("fp", "least_id", F.lit(True).alias("linked"))
    classes = cut(prints.join(named, "fp", "left").select("fp", F.when(F.col("linked"), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id")))
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the word shingles of a text, sorted; words as in ``simhash_udf``."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    shingles = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)) if len(words) >= width else iter([b" ".join(words)] if words else [])
    return np.unique(np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64))


def sample_prints_udf(width: int = WIDTH) -> Column:
    """A pandas UDF from text to the distinct ones of its ``SAMPLES`` fingerprints.

    A sample's draw is the shingle whose hash, mixed anew for each draw, is least, so two texts make the same draw with the chance of their Jaccard;
    the sample's fingerprint is the SimHash of the mixed hashes drawn. A text without words has fingerprint 0 alone.
    """

    @F.pandas_udf("array<long>")
    def sample_prints(texts: pd.Series) -> pd.Series:
        mix, turn = np.random.default_rng(11).integers(0, 1 << 64, (2, SAMPLES * DRAWS), dtype=np.uint64)
        turn |= np.uint64(1)

        def of(text: str | None) -> list[int]:
            own, least = shingle_set(text, width), np.full(SAMPLES * DRAWS, ~np.uint64(0))
            for at in range(0, len(own), 4096):
                least = np.minimum(least, ((own[at : at + 4096, None] ^ mix) * turn).min(axis=0))
            return np.unique(_majority(_ones(least.reshape(SAMPLES, DRAWS)), DRAWS)).tolist() if len(own) else [0]

        return pd.Series([of(x) for x in texts])

    return sample_prints


def _near_in_unit(sets: list[np.ndarray], parts: list[int], star: bool) -> list[tuple[int, int]]:
    """Pairs of places in ``sets`` of Jaccard ``LIKENESS`` or more that connect all such pairs, given what ``parts`` connects; with ``star`` only pairs of the first."""
    num, den = LIKENESS
    size = np.array([len(x) for x in sets])
    table = np.stack([np.bincount((x >> np.uint64(58)).astype(np.int64), minlength=PARTS) for x in sets])
    first: dict[int, int] = {}
    parent = [first.setdefault(p, i) for i, p in enumerate(parts)]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    for i in range(1 if star else len(sets) - 1):
        # by the triangle inequality at least this many shingles are in one set only; the likeness allows a part of both sizes
        apart, both = np.abs(table[i + 1 :] - table[i]).sum(axis=1), size[i + 1 :] + size[i]
        for j in (np.nonzero((num + den) * apart <= (den - num) * both)[0] + i + 1).tolist():
            if (x := root(i)) != (y := root(j)):
                common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if den * common >= num * (size[i] + size[j] - common):
                    parent[max(x, y)] = min(x, y)
                    links.append((i, j))
    return links


def _text_links(units: DataFrame, texts: DataFrame, width: int, star: bool) -> DataFrame:
    """``(src, dst)``: rows of a unit of ``units(key, lo, hi, later, row, part)`` whose texts are near; a star's first row is the one not ``later``."""
    rows = units.join(texts, "row").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "later", "row")

    def link(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit, ids, sets, parts = None, [], [], []

        def links() -> pd.DataFrame:
            found = [(ids[i], ids[j]) for i, j in _near_in_unit(sets, parts, star)] if len(sets) > 1 else []
            return pd.DataFrame(found, columns=["src", "dst"], dtype="int64")

        for frame in frames:
            for key, lo, hi, row, part, text in zip(*(frame[c] for c in ("key", "lo", "hi", "row", "part", "text")), strict=True):
                if unit != (key, lo, hi):
                    yield links()
                    unit, ids, sets, parts = (key, lo, hi), [], [], []
                ids.append(row)
                sets.append(shingle_set(text, width))
                parts.append(part)
        yield links()

    return rows.mapInPandas(link, "src long, dst long")


def jaccard_links(texts: DataFrame, width: int = WIDTH, unit: int = UNIT) -> DataFrame:
    """``(src, dst)``: links among the rows of ``texts(row, text)`` that connect those with a Jaccard of ``LIKENESS`` or more that share the fingerprint of a sample, their key.

    First each row of a key meets the key's least row, which settles most large groups. In a key that still holds several components, the rows outside
    the largest of them are cut into chunks that meet each other and the chunks of the largest: every pair of different components is verified, no key is
    left out for its size, and the work on a large group is its size times that of the rest. Only texts that share a key are shuffled, once.
    """
    prints = written(texts.select("row", sample_prints_udf(width)(F.col("text")).alias("prints")), "fingerprints")
    keyed = prints.select("row", F.explode("prints").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("row").alias("first")).filter("n > 1")
    members = cut(keyed.join(shared, "key").select("key", "row", "first"))
    texts = written(texts.join(members.select("row").distinct(), "row", "left_semi"), "candidates")
    stars = cut(members.filter("row <> first").select("first", "row").distinct())
    sizes = stars.groupBy("first").agg(F.ceil(F.count("*") / unit).alias("chunks"))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rays = stars.join(sizes, "first").select(F.col("first").alias("key"), F.pmod(F.xxhash64("row"), F.col("chunks")).alias("lo"), F.lit(True).alias("later"), "row")
    hubs = sizes.select(F.col("first").alias("key"), upto("chunks").alias("lo"), F.lit(False).alias("later"), F.col("first").alias("row"))
    units = rays.unionByName(hubs).withColumns({"hi": F.lit(0).cast("long"), "part": F.col("row")})
    found = cut(_text_links(units, texts, width, True))
    parts = connected_components(found).withColumnRenamed("node", "row")
    placed = cut(members.join(parts, "row", "left").select("key", "row", F.coalesce("component", "row").alias("part")))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("major"), F.max("n").alias("most"), F.sum("n").alias("n"), F.count("*").alias("m")).filter("m > 1")
    mixed = mixed.select("key", "major", F.ceil((F.col("n") - F.col("most")) / unit).alias("rest"), F.ceil(F.col("most") / unit).alias("of_major"))
    rows = placed.join(mixed, "key").withColumn("is_major", F.col("part") == F.col("major"))
    own = F.when(F.col("is_major"), F.col("rest") + F.pmod(F.xxhash64("row"), F.col("of_major"))).otherwise(F.pmod(F.xxhash64("row"), F.col("rest")))
    rows = rows.withColumns({"own": own, "meets": F.when(F.col("is_major"), F.col("rest")).otherwise(F.col("rest") + F.col("of_major"))})
    rows = rows.select("key", "row", "part", "own", upto("meets").alias("other"))
    units = rows.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), F.lit(True).alias("later"), "row", "part")
    return found.unionByName(cut(_text_links(units, texts, width, False)))


def keep_one(docs: DataFrame, width: int = WIDTH, unit: int = UNIT) -> DataFrame:
    """``docs`` with one row of each group of near copies by Jaccard, the first by ``doc_id`` (nulls last), with its own columns."""
    row = free_name(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    links = jaccard_links(numbered.select(F.col(row).alias("row"), "text"), width, unit)
    parts = connected_components(links).select(F.col("node").alias("row"), "component")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    grouped = cut(numbered.select(F.col(row).alias("row"), rank.alias("rank")).join(parts, "row"))
    least = grouped.groupBy("component").agg(F.min("rank").alias("least"))
    goes = grouped.join(least, "component").filter(F.col("rank.row") != F.col("least.row")).select(F.col("row").alias(row))
    return numbered.join(goes, row, "left_anti").select(*own_columns(docs))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
