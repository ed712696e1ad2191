"""Faces: the nearest known face, clusters of the rest, and people that look alike.

Vectors meet in blocks of bounded size, of which only those meet that can hold near vectors (``operators/vectors.py``); distances inside a pair of
blocks are numpy products of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.components import connected_components
from shutterlake.operators.vectors import celled, each_pair, pivots_for, tiles
from shutterlake.session import cut

#: Faces of a chunk of a person, of which means are made.
ROWS = 2048


def assigned_faces(faces: DataFrame, gallery: DataFrame, threshold: float = 0.48) -> DataFrame:
    """``(id, person_id, distance)``: for each of ``faces(id, descriptor)`` the person of the nearest of ``gallery(id, person_id, descriptor)``, smaller id on ties, if nearer than the threshold."""
    points = pivots_for(gallery)

    def nearest(a, b, same):
        order = np.argsort(b["id"], kind="stable")
        ids, people, v = b["id"][order], b["person_id"][order], b["v"][order]
        best, near = np.zeros(len(a["id"]), dtype=np.int64), np.zeros(len(a["id"]))
        for at, gap in tiles(a["v"], v):
            least = gap.argmin(axis=1)
            best[at : at + len(gap)], near[at : at + len(gap)] = least, gap[np.arange(len(gap)), least]
        ok = near < threshold
        return pd.DataFrame({"id": a["id"][ok], "near_id": ids[best[ok]], "person_id": people[best[ok]], "distance": near[ok]})

    found = each_pair(nearest, "id long, near_id long, person_id long, distance double", celled(faces, (), points), celled(gallery, ("person_id",), points), threshold)
    return found.groupBy("id").agg(F.min_by("person_id", F.struct("distance", "near_id")).alias("person_id"), F.min("distance").alias("distance"))


def clustered_faces(faces: DataFrame, threshold: float = 0.48) -> DataFrame:
    """``(id, cluster_id)``: components of the graph that links faces nearer than the threshold; a cluster's id is its least face. The result doesn't depend on order, unlike one-by-one assignment.

    A pair of blocks gives each of its faces at most one link, to the least face that it reaches inside the pair, so a person of k faces costs k links, not k^2.
    """
    own = celled(faces, (), pivots_for(faces))

    def links(a, b, same):
        ids = np.unique(np.concatenate([a["id"], b["id"]]))
        at_a, at_b = np.searchsorted(ids, a["id"]), np.searchsorted(ids, b["id"])
        least = np.arange(len(ids))
        for at, gap in tiles(a["v"], b["v"]):
            i, j = np.nonzero(gap < threshold)
            i, j = least[at_a[at + i]], least[at_b[j]]
            while (apart := i != j).any():  # each part joins the least that it meets
                i, j, up = i[apart], j[apart], np.arange(len(ids))
                np.minimum.at(up, np.maximum(i, j), np.minimum(i, j))
                while (up[up] != up).any():
                    up = up[up]
                least, i, j = up[least], up[i], up[j]
        own = least != np.arange(len(ids))
        return pd.DataFrame({"src": ids[own], "dst": ids[least[own]]})

    parts = connected_components(each_pair(links, "src long, dst long", own, own, threshold, True))
    return faces.select("id").join(parts, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("cluster_id"))


def _means(faces: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(a, b, mean)``: mean distance between the faces of each of ``pairs(a, b)`` of people, whose faces meet in chunks of bounded size."""
    sizes = faces.groupBy("person_id").agg(F.ceil(F.count("*") / ROWS).alias("chunks"))
    chunk = F.pmod(F.xxhash64("id"), F.col("chunks"))
    own = faces.join(sizes, "person_id").groupBy("person_id", chunk.alias("chunk")).agg(F.collect_list("descriptor").alias("v"))
    side = lambda x: own.select(F.col("person_id").alias(x), F.col("chunk").alias(f"chunk_{x}"), F.col("v").alias(f"v_{x}"))

    def sums(frame: pd.DataFrame) -> pd.DataFrame:
        p, q = (np.vstack(frame[c].iloc[0]).astype(np.float64) for c in ("v_a", "v_b"))
        return pd.DataFrame({"a": frame["a"], "b": frame["b"], "total": sum(gap.sum() for _, gap in tiles(p, q)), "n": len(p) * len(q)})

    met = pairs.join(side("a"), "a").join(side("b"), "b").groupBy("a", "b", "chunk_a", "chunk_b")
    return met.applyInPandas(sums, "a long, b long, total double, n long").groupBy("a", "b").agg((F.sum("total") / F.sum("n")).alias("mean"))


def merge_suggestions(faces: DataFrame, sure: float = 0.44, likely: float = 0.48, best: float = 0.32) -> DataFrame:
    """Pairs of people a < b that may be one: least and mean distance of their faces, blended if both have more than two, and a confidence.

    A mean is never below the least distance, so only people with two faces within the larger limit can qualify: these are found first, and means are
    made for them alone. Where the limits reach every distance, least and mean come from the same distances.
    """
    own = celled(faces, ("person_id",), pivots_for(faces))
    reach = max(sure, likely) if max(sure, likely) < 1 else float("inf")  # distances count as 1 at most

    def near(a, b, same):
        (pa, va), (pb, vb) = ((x["person_id"][o], x["v"][o]) for x in (a, b) for o in [np.argsort(x["person_id"], kind="stable")])
        to = np.flatnonzero(np.append(True, pb[1:] != pb[:-1]))
        found = []
        for at, gap in tiles(va, vb):
            p = pa[at : at + len(gap)]
            of = np.flatnonzero(np.append(True, p[1:] != p[:-1]))
            least, total = (f.reduceat(f.reduceat(gap, to, axis=1), of, axis=0) for f in (np.minimum, np.add))
            x, y = np.broadcast_arrays(p[of][:, None], pb[to][None, :])
            n = np.diff(np.append(of, len(p)))[:, None] * np.diff(np.append(to, len(pb)))[None, :]
            ok = (x < y) if same else (x != y)  # a block with itself has each pair of faces twice
            found.append(pd.DataFrame({"a": np.minimum(x, y)[ok], "b": np.maximum(x, y)[ok], "least": least[ok], "total": total[ok], "n": n[ok]}))
        return pd.concat(found).groupby(["a", "b"], as_index=False).agg({"least": "min", "total": "sum", "n": "sum"})

    met = each_pair(near, "a long, b long, least double, total double, n long", own, own, reach, True)
    found = cut(met.groupBy("a", "b").agg(F.min("least").alias("least"), (F.sum("total") / F.sum("n")).alias("mean")).filter(F.col("least") <= reach))
    # without a reach all faces have met; else blocks out of reach have not, and means are made of the pairs found
    by_pair = found if reach == float("inf") else found.drop("mean").join(_means(faces, found.select("a", "b")), ["a", "b"])
    counts = faces.groupBy("person_id").agg(F.count("*").alias("n"))
    side = lambda x: counts.select(F.col("person_id").alias(x), F.col("n").alias(f"n_{x}"))
    least = F.least("least", F.lit(1.0))
    eff = F.when((F.col("n_a") > 2) & (F.col("n_b") > 2), 0.65 * least + 0.35 * F.col("mean")).otherwise(least)
    rated = by_pair.join(side("a"), "a").join(side("b"), "b").withColumn("effective", eff).filter((least <= sure) | (F.col("effective") <= likely))
    level = F.when(F.col("effective") <= best, 99).when(F.col("effective") <= likely, F.round(99 - (F.col("effective") - best) / (likely - best) * 24)).otherwise(F.greatest(F.lit(50), F.round(75 - (F.col("effective") - likely) / 0.12 * 25)))
    return rated.select("a", "b", F.round(least, 4).alias("distance"), F.round("effective", 4).alias("effective"), level.cast("int").alias("confidence"))


def auto_merges(suggestions: DataFrame, dismissed: DataFrame, least: int = 90) -> DataFrame:
    """``(old, new)`` for everyone who joins a smaller id: all suggestions of at least that confidence that nobody dismissed, or all of them if there are none."""
    open_ = cut(suggestions.join(dismissed, ["a", "b"], "left_anti"))
    strong = open_.filter(F.col("confidence") >= least)
    chosen = open_ if strong.isEmpty() else strong
    parts = connected_components(chosen.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return parts.filter("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new"))
