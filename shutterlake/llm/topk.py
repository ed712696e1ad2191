"""Exact top-k inner-product search by distributed histogram selection.

Method. Vectors are packed into blocks once and stay where they are. Queries come in waves, dealt by a hash of their ids, each of a
bounded number and size; a wave is broadcast, and a round is one pass over the blocks that scores everything. A task counts the scores of
each query in ``BINS`` equal bins of its current range, and only the counts cross the network. The next range is the bin that holds the
k-th largest score. Scores are integers, so a range of width one is the exact k-th value, after at most ceil(log(range) / log(BINS))
rounds. A last pass keeps scores at or above it, and ties go to the smaller id. The driver holds the vectors and ranges of one wave.

Defined cases: a vector that is null, empty or holds a null, NaN or infinite component takes no part, and neither does
a row with a null id. Only vectors of equal length meet. A query's own id is never its candidate, even on a repeated
row; other repeated rows are candidates each. A query id on several rows stands once, with the least of its vectors.
Fewer than k candidates: all of them. Scores beyond 64 bits end at the limits of a long. An empty table or no queries:
an empty result. Other columns play no part.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.session import cut, shared_dir, written
from shutterlake.sources.tables import read_table

BINS = 256
#: Vectors in a block, and queries whose scores a task holds at a time.
VECTORS, SLICE = 4096, 128
#: Queries of a wave and bytes of their vectors, on average; hashes deal them out evenly.
WAVE, WAVE_BYTES = 8192, 32 << 20
_TOP = (1 << 63) - 1
#: Ranges stay within this, so that their differences fit a long; what lies beyond counts as above the range.
_REACH = 1 << 61


def quantised(components: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, kept as doubles; those of 2^53 and more are whole already."""

    def one(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)

    return F.transform(components, one)


def _dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64; doubles where they are exact, Python's integers elsewhere."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    bound = float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1]
    if bound < 2**53:
        return (q @ v.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in v], dtype=object).T
    return np.array([[max(-_TOP - 1, min(_TOP, x)) for x in row] for row in whole], dtype=np.int64).reshape(len(q), len(v))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """``rows(dim, id, vec)`` in blocks of up to ``size`` rows of one length, made where the rows are."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for dim, part in frame.groupby("dim"):
                for at in range(0, len(part), size):
                    own = part.iloc[at : at + size]
                    yield pd.DataFrame({"dim": [dim], "ids": [own["id"].to_numpy(np.int64).tobytes()], "mat": [np.vstack(own["vec"].to_numpy()).astype(np.float64).tobytes()]})

    return rows.mapInPandas(pack, "dim int, ids binary, mat binary")


#: What a wave asks, by length of vector: ids, vectors, lowest score and width of a bin.
Asked = dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def _wave(rows: DataFrame, reach: float, bins: int) -> Asked:
    """The queries ``rows(dim, id, vec)`` of one wave with ranges that hold all their scores."""
    out: Asked = {}
    for dim, part in rows.toPandas().groupby("dim"):
        q = np.vstack(part["vec"].to_numpy()).astype(np.float64)
        # |score| <= sum |q| * max |v|; kept within 2^61 so that ranges fit a long
        bound = np.minimum(np.ceil(np.abs(q).sum(axis=1) * reach) + 1, float(_REACH)).astype(np.int64)
        out[int(dim)] = part["id"].to_numpy(np.int64), q, -bound, -(-(2 * bound + 1) // bins)
    return out


def _met(frames: Iterator[pd.DataFrame], asked: Asked) -> Iterator[tuple]:
    """Of each block and each slice of the queries of its length: length, place of the slice, ids of the block, scores, and which of them count (not those of a query with itself)."""
    for frame in frames:
        for r in frame.itertuples():
            if r.dim not in asked:
                continue
            ids, v = np.frombuffer(r.ids, np.int64), np.frombuffer(r.mat, np.float64).reshape(-1, r.dim)
            q_ids, q, lo, _ = asked[r.dim]
            for at in range(0, len(q), SLICE):
                own = slice(at, at + SLICE)
                scores = _dots(q[own], v)
                yield r.dim, at, ids, scores, (np.maximum(scores, -_REACH) >= lo[own, None]) & (q_ids[own, None] != ids[None, :])


def _histograms(wave: Broadcast, bins: int) -> Callable:
    """Counts by query and bin, one sum a task. Bin b covers [lo + b * width, lo + (b + 1) * width); what is above the range is bin ``bins``."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, sums = wave.value, {}
        for dim, at, _, scores, ok in _met(frames, asked):
            q_ids, _, lo, width = asked[dim]
            total = sums.setdefault(dim, np.zeros(len(q_ids) * (bins + 1), np.int64))
            i, j = np.nonzero(ok)
            b = np.minimum((np.clip(scores[i, j], -_REACH, _REACH) - lo[at + i]) // width[at + i], bins)
            own = total[at * (bins + 1) : (at + len(scores)) * (bins + 1)]
            own += np.bincount(i * (bins + 1) + b, minlength=len(own))
        for dim, total in sums.items():
            cells = np.nonzero(total)[0]
            for part in np.array_split(cells, len(cells) // (1 << 18) + 1):
                yield pd.DataFrame({"query_id": asked[dim][0][part // (bins + 1)], "bin": (part % (bins + 1)).astype(np.int32), "n": total[part]})

    return count


def _candidates(wave: Broadcast, k: int) -> Callable:
    """Scores at or above each query's k-th value; of a task, at most the k best by (score, smaller id), as no other can be chosen."""

    def best(held: list[pd.DataFrame]) -> pd.DataFrame:
        return pd.concat(held).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).groupby("query_id").head(k)

    def keep(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, held, n = wave.value, [], 0
        most = max(1 << 19, 2 * k * sum(len(x[0]) for x in asked.values()))
        for dim, at, ids, scores, ok in _met(frames, asked):
            i, j = np.nonzero(ok)
            held.append(pd.DataFrame({"query_id": asked[dim][0][at + i], "vec_id": ids[j], "score": scores[i, j]}))
            n += len(i)
            if n > most:
                held = [best(held)]
                n = len(held[0])
        if held:
            yield best(held)

    return keep


def _kth(spark: SparkSession, blocks: DataFrame, asked: Asked, k: int, bins: int) -> Asked:
    """``asked`` with each query's lowest score moved up to its k-th best; where there are fewer than k, it stays."""
    down = Window.partitionBy("query_id").orderBy(F.desc("bin"))  # at most `bins` + 1 rows a query
    now = asked
    while now:
        wave = spark.sparkContext.broadcast(now)
        counts = blocks.mapInPandas(_histograms(wave, bins), "query_id long, bin int, n long").groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        run = counts.withColumn("reached", F.sum("n").over(down))
        holds = run.filter((F.col("reached") >= k) & (F.col("reached") - F.col("n") < k)).select("query_id", "bin")
        found = dict(holds.toPandas().itertuples(index=False))  # a row a query of the wave at most
        wave.destroy()
        rest: Asked = {}
        for dim, (ids, q, lo, width) in now.items():
            b = np.array([found.get(i, -1) for i in ids.tolist()], np.int64)
            lo = np.where(b >= 0, lo + np.maximum(b, 0) * width, lo)
            own = asked[dim]
            own[2][np.searchsorted(own[0], ids)] = lo
            go = (b >= 0) & (width > 1)
            if go.any():
                rest[dim] = ids[go], q[go], lo[go], -(-width[go] // bins)
        now = rest
    return asked


RANKED = "query_id long, rank int, vec_id long, score long"


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", bins: int = BINS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k best candidates of each row of ``vectors`` for which ``is_query`` holds."""
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    clean = vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & ~bad)
    rows = clean.select(F.size(vec_col).alias("dim"), F.col(id_col).cast("long").alias("id"), quantised(F.col(vec_col), scale).alias("vec"), is_query.alias("asks"))
    spark = vectors.sparkSession
    blocks = written(_packed(rows.select("dim", "id", "vec"), VECTORS), "vectors")
    asked = cut(rows.filter("asks").groupBy("id").agg(F.min(F.struct("dim", "vec")).alias("x")).select("id", "x.dim", "x.vec"))
    n, size = asked.agg(F.count("*"), F.sum("dim") * 8).first()
    if not n:
        return spark.createDataFrame([], RANKED)
    waves = max(-(-n // WAVE), -(-size // WAVE_BYTES))
    dealt = asked.withColumn("wave", F.pmod(F.xxhash64("id"), F.lit(waves)).cast("int"))
    if waves > 1:  # so that a wave reads its own row groups
        dealt = written(dealt.repartitionByRange("wave", "id").sortWithinPartitions("wave"), "queries")
    reach = float(rows.agg(F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x))))).first()[0])
    path, best = f"{shared_dir(spark)}/topk-{uuid.uuid4().hex}", Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    for w in range(waves):
        own = _wave(dealt.filter(F.col("wave") == w).select("dim", "id", "vec").orderBy("id"), reach, bins)
        if not own:
            continue
        wave = spark.sparkContext.broadcast(_kth(spark, blocks, own, k, bins))
        found = blocks.mapInPandas(_candidates(wave, k), "query_id long, vec_id long, score long")
        found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(*[c.split()[0] for c in RANKED.split(", ")]).write.parquet(f"{path}/wave={w}")
        wave.destroy()
    return spark.read.schema(RANKED + ", wave int").parquet(path).drop("wave")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.vec) = len(c.vec)
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
