"""Vectors in cells around pivots, and the pairs of blocks of them that can hold near vectors.

A vector lies in the cell of its nearest pivot; a cell is cut into blocks of bounded size. Two vectors are at least as far apart as their distances to
any one pivot differ, so two cells whose distances to some pivot differ by more than a limit everywhere hold no pair within it, and their blocks never
meet. What is found doesn't depend on the pivots, only the work does: on vectors without clusters all blocks meet.

Rows whose vector is null or holds null or non-finite entries take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.session import cut

#: Most rows of a block, at about. A block is copied once for each block that it meets, so bytes shuffled fall as this rises.
ROWS = 16_384
#: Distances that a task holds at once.
TILE = 1 << 21
#: Most pivots. Bounds are kept for each cell and pivot, so this squared is what the driver holds.
PIVOTS = 128
#: Rows among which pivots are chosen.
SAMPLE = 4096


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def _matrix(packed, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(packed), dtype=kind).reshape(len(packed), -1).astype(np.float64)


def tiles(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The distances between the rows of ``a`` and ``b``, some rows of ``a`` at a time, each with its first row."""
    step = max(1, TILE // max(1, len(b)))
    for at in range(0, len(a), step):
        yield at, distances(a[at : at + step], b)


def chosen_pivots(df: DataFrame, count: int) -> np.ndarray:
    """Up to ``count`` vectors of ``df(id, descriptor)``, each the farthest from those before, out of the ``SAMPLE`` rows with the least hashes of ids."""
    sample = df.filter("descriptor is not null").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("descriptor").collect()
    whole = [v for v in (np.array(r.descriptor, dtype=np.float64) for r in sample) if np.isfinite(v).all()]
    if not whole:
        return np.zeros((0, 0))
    points, picked = np.vstack(whole), [0]
    gap = distances(points, points[:1])[:, 0]
    while len(picked) < count and gap.max() > 0:
        picked.append(int(gap.argmax()))
        gap = np.minimum(gap, distances(points, points[picked[-1:]])[:, 0])
        gap[picked] = 0
    return points[picked]


@dataclass(frozen=True)
class Cells:
    """Rows ``(id, extra, v, cell)``, the rows of each cell and the least and largest distance of a cell's rows to each pivot."""

    rows: DataFrame
    extra: tuple[str, ...]
    sizes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    scale: float
    kind: str

    @property
    def parts(self) -> np.ndarray:
        return -(-self.sizes // ROWS)

    @property
    def starts(self) -> np.ndarray:
        """The number of each cell's first block."""
        return np.cumsum(self.parts) - self.parts


def celled(df: DataFrame, extra: tuple[str, ...], points: np.ndarray) -> Cells:
    """Each row of ``df(id, descriptor)`` with its cell, computed once and written."""
    kinds = dict(df.dtypes)
    kind = "<f4" if kinds["descriptor"] == "array<float>" else "<f8"
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("id", *extra)) + ", v binary, cell int"

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame) and len(points):
                v = np.vstack(frame["descriptor"]).astype(np.float64)
                ok = np.isfinite(v).all(axis=1)
                v, frame = v[ok], frame[ok]
                if len(frame):
                    yield frame.drop(columns="descriptor").assign(v=[x.tobytes() for x in v.astype(kind)], cell=distances(v, points).argmin(axis=1).astype(np.int32))

    def bounds(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(points)
        sizes, low, high = np.zeros(k, dtype=np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)
        for frame in frames:
            if len(frame):
                cell, gap = frame["cell"].to_numpy(), distances(_matrix(list(frame["v"]), kind), points)
                np.add.at(sizes, cell, 1)
                np.minimum.at(low, cell, gap)
                np.maximum.at(high, cell, gap)
        seen = np.flatnonzero(sizes)
        if len(seen):
            yield pd.DataFrame({"cell": seen, "n": sizes[seen], "low": list(low[seen]), "high": list(high[seen])})

    own = cut(df.filter("descriptor is not null").select("id", *extra, "descriptor").mapInPandas(assign, schema))
    k = len(points)
    sizes, low, high = np.zeros(k, dtype=np.int64), np.full((k, k), np.inf), np.full((k, k), -np.inf)
    by_task = own.select("cell", "v").mapInPandas(bounds, "cell long, n long, low array<double>, high array<double>")
    each = by_task.select("cell", "n", F.posexplode(F.arrays_zip("low", "high")).alias("pivot", "b"))
    for r in each.groupBy("cell", "pivot").agg(F.sum("n").alias("n"), F.min("b.low").alias("low"), F.max("b.high").alias("high")).collect():
        sizes[r.cell], low[r.cell, r.pivot], high[r.cell, r.pivot] = r.n, r.low, r.high
    reach = high[np.isfinite(high)].max(initial=0.0)
    return Cells(own, extra, sizes, low, high, 1 + reach + (np.sqrt((points**2).sum(axis=1)).max() if k else 0.0), kind)


def near_cells(a: Cells, b: Cells, limit: float) -> np.ndarray:
    """Whether a row of each cell of ``a`` can lie within ``limit`` of a row of each cell of ``b``."""
    near = (a.sizes > 0)[:, None] & (b.sizes > 0)[None, :]
    slack = limit + 1e-6 * max(a.scale, b.scale)  # of rounding
    for k in range(len(a.sizes)):
        near &= np.maximum(a.low[:, None, k] - b.high[None, :, k], b.low[None, :, k] - a.high[:, None, k]) <= slack
    return near


def _blocks(own: Cells, near: np.ndarray, partners: Cells, mine: str, theirs: str, rows: str) -> DataFrame:
    """The blocks of ``own``, once for each block of ``partners`` in a near cell."""
    ranges = [[(int(partners.starts[j]), int(partners.starts[j] + partners.parts[j] - 1)) for j in np.flatnonzero(line)] for line in near]
    table = [(c, int(own.starts[c]), int(own.parts[c]), ranges[c]) for c in range(len(own.sizes)) if own.sizes[c]]
    spark = own.rows.sparkSession
    cells = F.broadcast(spark.createDataFrame(table, "cell int, start int, parts int, ranges array<struct<first:int,last:int>>"))  # PIVOTS rows at most
    numbered = own.rows.join(cells.select("cell", "start", "parts"), "cell").withColumn("block", F.col("start") + F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    packed = numbered.groupBy("block", "cell").agg(F.collect_list(F.struct("id", "v", *own.extra)).alias("rows"))
    packed = packed.select("block", "cell", F.struct(*[F.col(f"rows.{c}").alias(c) for c in ("id", "v", *own.extra)]).alias(rows))  # an array for each column
    spread = packed.join(cells.select("cell", F.explode("ranges").alias("r")), "cell")
    return spread.select(F.col("block").alias(mine), rows, F.explode(F.sequence("r.first", "r.last")).alias(theirs))


def block_pairs(a: Cells, b: Cells, limit: float, triangle: bool = False) -> DataFrame:
    """``(i, j, a, b)``: each two blocks that can hold rows within ``limit``, by an equi-join on both numbers; if ``triangle``, each two blocks of one table once."""
    near = near_cells(a, b, limit)
    left, right = _blocks(a, near, b, "i", "j", "a"), _blocks(b, near.T, a, "j", "i", "b")
    if triangle:
        left, right = left.filter("i <= j"), right.filter("i <= j")
    return left.join(right, ["i", "j"])


def each_pair(kernel: Callable, schema: str, a: Cells, b: Cells, limit: float, triangle: bool = False) -> DataFrame:
    """``kernel(x, y, same)`` of each two blocks of ``block_pairs``: dicts of arrays by column, ``v`` a matrix; ``same`` if both are one block. A task holds one pair at a time."""
    columns = {"a": ("id", *a.extra), "b": ("id", *b.extra)}
    kinds = {"a": a.kind, "b": b.kind}

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, y = ({c: np.asarray(frame[f"{s}_{c}"].iloc[0]) for c in columns[s]} | {"v": _matrix(list(frame[f"{s}_v"].iloc[0]), kinds[s])} for s in ("a", "b"))
        return kernel(x, y, triangle and key[0] == key[1])

    pairs = block_pairs(a, b, limit, triangle)
    flat = pairs.select("i", "j", *[F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in ("a", "b") for c in (*columns[s], "v")])
    return flat.groupBy("i", "j").applyInPandas(run, schema)


def pivots_for(df: DataFrame) -> np.ndarray:
    """A pivot for an eighth of a block's rows, ``PIVOTS`` at most."""
    return chosen_pivots(df, min(PIVOTS, max(1, -(-df.count() // max(1, ROWS // 8)))))
