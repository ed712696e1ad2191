"""Text quality by ordinal cumulative-link regression.

Method. Graded ratings y = 0..G-1 follow P(y <= j) = sigmoid(t_j - s) with ordered thresholds t_0 < t_1 < ... and, for all grades, one score s: the
sum of the weights of a text's hashed features, divided by the root of how many of them have a weight, so that length alone moves no text. From them come the expected grade and the tail probability P(y >= G-1), by which texts are selected.

Ratings are graded from the labels: 0 if quality is 0, 1 if quality is 1 but the text is toxic, 2 if quality is 1 and it isn't. Features of a text are
its distinct words and runs of marks, hashed, and what share of it are marks, digits and capitals, in ten steps each. The model is fitted on
a bounded sample: at most ``SAMPLE`` labelled texts of those that aren't held out, chosen by a hash of their id. Features have a weight if they are on
``RARE`` texts of it or more, some grade has them ``SIGNIFICANT`` standard deviations more or less often than all do, and some grade is ``LIFT`` times as
likely with them or more: what only most texts have, such as common words, would otherwise outweigh a few telling ones. Scoring covers whole texts.

Defined cases: a null text counts as empty. Rows with a null label or id teach nothing; of several labels of one id, and of several texts, each pair
counts. With no rating at all every text has grade and probability 0.5 of the range and is kept. Repeated rows give equal rows, an
empty table an empty result; other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.names import free_name
from shutterlake.session import cut
from shutterlake.sources.tables import read_table

SAMPLE, RARE, SIGNIFICANT, LIFT, BITS, GRADES = 12000, 4, 4.0, 1.5, 18, 3
#: Texts whose probability of the highest grade is at least this are kept.
KEEP = 0.4
CACHED = 400_000


class Features:
    """Distinct hashed features of a text, as sorted numbers below 2^bits; one per task."""

    def __init__(self, bits: int = BITS):
        self.mask, self.known = (1 << bits) - 1, {}
        # ASCII letters and digits and all bytes beyond ASCII make words; the other printable ASCII makes runs of marks
        self.words = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+|[!-/:-@\[-`]+")

    def number(self, word: bytes) -> int:
        if (n := self.known.get(word)) is None:
            if len(self.known) >= CACHED:
                self.known.clear()
            n = crc32(word) & self.mask
            if len(word) <= 48:
                self.known[word] = n
        return n

    def of(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        words = set(self.words.findall(raw.lower()))
        total = max(1, len(raw))
        kinds = np.bincount(_KIND[np.frombuffer(raw, np.uint8)], minlength=4)
        shape = [b"\0%d %d" % (k, min(9, int(20 * kinds[k] / total))) for k in (1, 2, 3)]
        return np.unique(np.fromiter(map(self.number, [*words, *shape]), np.int32))


#: By byte: 1 a mark, 2 a digit, 3 a capital, else 0.
_KIND = np.array([2 if chr(b).isdigit() and b < 128 else 3 if 65 <= b <= 90 else 1 if 33 <= b < 127 and not chr(b).isalnum() else 0 for b in range(256)], np.uint8)


@dataclass
class Ordinal:
    """``weighed``: which features have a weight."""

    weights: np.ndarray
    weighed: np.ndarray
    thresholds: np.ndarray

    def scores(self, features: list[np.ndarray]) -> np.ndarray:
        own = [f[self.weighed[f]] for f in features]
        return np.array([self.weights[f].sum() / np.sqrt(max(1, len(f))) for f in own])

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(y >= j) for j = 1..G-1, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -500, 500)))


def telling(counts: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Which features have a weight. ``counts[g, f]``: texts of grade g with feature f; ``texts[g]``: texts of grade g."""
    seen = counts.sum(axis=0)
    part = (texts / texts.sum())[:, None]
    off = np.abs(counts - seen * part)
    lifted = (counts >= LIFT * seen * part).any(axis=0)
    return lifted & ((seen >= RARE) & (off >= SIGNIFICANT * np.sqrt(np.maximum(seen * part * (1 - part), 1e-9)))).any(axis=0)


def loss(w: np.ndarray, raw: np.ndarray, flat: np.ndarray, owner: np.ndarray, value: np.ndarray, y: np.ndarray, share: np.ndarray, ridge: float) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean negative log-likelihood with its ridge, of texts ``owner`` that have features ``flat`` with ``value``; and its derivatives by weights and by ``raw``: the first threshold and the logarithms of the steps after it, so that thresholds stay in order."""
    n_grades = len(raw) + 1
    score = np.bincount(owner, w[flat] * value, len(y))
    t = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
    edges = np.concatenate([[-np.inf], t, [np.inf]])
    with np.errstate(over="ignore"):
        upper, lower = 1 / (1 + np.exp(-(edges[y + 1] - score))), 1 / (1 + np.exp(-(edges[y] - score)))
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
    d_score = share * (du - dl)
    d_edges = np.zeros(n_grades + 1)
    np.add.at(d_edges, y + 1, -share * du)
    np.add.at(d_edges, y, share * dl)
    d_t = d_edges[1:-1]
    tail = np.cumsum(d_t[::-1])[::-1]  # each step moves every threshold after it
    d_raw = np.concatenate([tail[:1], tail[1:] * np.exp(raw[1:])])
    return float(-(share * np.log(p)).sum() + ridge / 2 * (w * w).sum()), np.bincount(flat, d_score[owner] * value, len(w)) + ridge * w, d_raw


def fit(features: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, bits: int = BITS, rounds: int = 600, ridge: float = 3e-4) -> Ordinal:
    """Adam on ``loss``; grades count equally, rare as they may be."""
    flat, owner = np.concatenate(features).astype(np.int64), np.repeat(np.arange(len(features)), [len(f) for f in features])
    y = grades
    keep = telling(np.stack([np.bincount(flat[y[owner] == g], minlength=1 << bits) for g in range(n_grades)]), np.bincount(y, minlength=n_grades))[flat]
    used, flat = np.unique(flat[keep], return_inverse=True)
    owner = owner[keep]
    value = 1 / np.sqrt(np.bincount(owner, minlength=len(y)))[owner]
    w, raw = np.zeros(len(used)), np.array([-1.0] + [0.0] * (n_grades - 2))
    share = 1 / np.maximum(1, np.bincount(y, minlength=n_grades))[y]
    share = share / share.sum()
    moments = [[np.zeros_like(v), np.zeros_like(v)] for v in (w, raw)]
    for step in range(1, rounds + 1):
        _, d_w, d_raw = loss(w, raw, flat, owner, value, y, share, ridge)
        for v, g, (a, b) in zip((w, raw), (d_w, d_raw), moments, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            v -= 0.05 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-10)
    weights, weighed = np.zeros(1 << bits), np.zeros(1 << bits, bool)
    weights[used], weighed[used] = w, True
    return Ordinal(weights, weighed, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])])))


def held_out_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 1


def graded(labels: DataFrame) -> DataFrame:
    """``(doc_id, grade)`` of the complete rows of ``labels``."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") != 0, 1).otherwise(2)
    return labels.filter("doc_id is not null and quality is not null and toxic is not null").select("doc_id", grade.alias("grade"))


def learned(docs: DataFrame, ratings: DataFrame, sample: int = SAMPLE) -> Ordinal | None:
    """A model of ``ratings(doc_id, grade)``, fitted on at most ``sample`` of them; None if there are none.

    What reaches the driver is the count of each feature by grade, 2^``BITS`` numbers a grade at most, and then of each text of the sample only the features
    that have a weight.
    """
    chosen = ratings.filter(~held_out_of(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)

    @F.pandas_udf("array<int>")
    def features(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Features()
        for part in texts:
            yield part.map(own.of)

    # at most `sample` rows of two numbers, so this side is broadcast; an id may be on many rows
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", features("text").alias("f"))
    found = cut(found.orderBy(F.xxhash64("doc_id"), "doc_id", "grade", "f").limit(sample))
    grades = dict(found.groupBy("grade").count().collect())
    if not grades:
        return None
    counts = np.zeros((GRADES, 1 << BITS), np.int64)
    for r in found.select("grade", F.explode("f").alias("x")).groupBy("grade", "x").count().filter("count > 0").toLocalIterator():
        counts[r[0], r[1]] = r[2]
    weighed = found.sparkSession.sparkContext.broadcast(telling(counts, np.array([grades.get(g, 0) for g in range(GRADES)])))

    @F.pandas_udf("binary")
    def kept(parts: pd.Series) -> pd.Series:
        return parts.map(lambda f: f[weighed.value[f]].astype("<i4").tobytes())

    rows = found.select("doc_id", "grade", kept("f").alias("f")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.grade, r.f))
    return fit([np.frombuffer(r.f, "<i4") for r in rows], np.array([r.grade for r in rows]))


def rated(docs: DataFrame, model: Ordinal | None, keep: float = KEEP) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_prob`` (of the highest grade) and ``kept``, which replace columns of these names."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the data

    @F.pandas_udf("expected_grade double, tail_prob double")
    def rate(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own, model = Features(), shared.value
        for texts in parts:
            if model is None or not len(texts):
                yield pd.DataFrame({"expected_grade": [(GRADES - 1) / 2] * len(texts), "tail_prob": [0.5] * len(texts)})
                continue
            tails = model.tails(model.scores([own.of(t) for t in texts]))
            yield pd.DataFrame({"expected_grade": tails.sum(axis=1), "tail_prob": tails[:, -1]})

    both = free_name(docs, "_rating")
    out = docs.withColumn(both, rate(F.col("text")))
    return out.withColumns({"expected_grade": F.col(f"{both}.expected_grade"), "tail_prob": F.col(f"{both}.tail_prob"), "kept": F.col(f"{both}.tail_prob") >= keep}).drop(both)


def op10_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, graded(read_table(spark, sf_dir, "labels")))
    return rated(docs, model).select("doc_id", held_out_of(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_prob", "kept")
