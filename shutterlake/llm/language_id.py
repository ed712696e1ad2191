"""Language identification by a byte convolutional network.

Method. Filters of several widths slide over one-hot bytes; each keeps its largest response in a window (max pooling), and a softmax
over the pooled responses gives a probability for each language. The network is trained here, in numpy, on windows of labelled
texts; a whole text is cut into windows of ``WINDOW`` bytes, and its probabilities are those of its windows, weighed by their bytes.

Training takes a bounded sample: at most ``SAMPLE`` labelled texts, chosen by a hash so that languages are about equally many, and
up to ``PER_TEXT`` windows of each. Prediction covers every byte of every text.

Defined cases: a text that is null or has no letter is ``und`` with score 0. With no labelled text to learn from every text is
``und``. Texts of any length are read whole. Repeated rows give equal rows, an empty table an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.names import free_name, own_columns
from shutterlake.session import cut
from shutterlake.sources.tables import read_table

WINDOW = 256
WIDTHS, FILTERS = (2, 3, 4), 24
SAMPLE, PER_TEXT, EPOCHS = 3000, 2, 5
#: Rows of counts that are broadcast at most.
BROADCAST = 20_000
UNKNOWN = "und"
#: Bytes for which responses are held at a time.
STEP = 1 << 17


@dataclass
class Network:
    """``tables[k][j]``: responses of the filters of the k-th width to each byte at offset j; byte 256 is padding and gives none."""

    labels: list[str]
    tables: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Largest responses of each filter in each row of ``windows`` (of byte numbers), and where they are."""
        tops, places = [], []
        for table in self.tables:
            width = len(table)
            n = windows.shape[1] - width + 1
            response = table[0].take(windows[:, :n], axis=0)
            for j in range(1, width):
                response += table[j].take(windows[:, j : j + n], axis=0)
            place = response.argmax(axis=1)
            places.append(place)
            tops.append(np.take_along_axis(response, place[:, None, :], axis=1)[:, 0])
        return np.concatenate(tops, axis=1), places

    def probabilities(self, pooled: np.ndarray) -> np.ndarray:
        logits = np.maximum(pooled, 0) @ self.weights + self.bias
        odds = np.exp(logits - logits.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)


def windows_of(data: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Byte numbers in rows of ``window``, the last one padded with 256, and the bytes in each row."""
    n = max(1, -(-len(data) // window))
    out = np.full(n * window, 256, np.int16)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, window), np.minimum(window, len(data) - np.arange(n) * window)


def gradients(net: Network, x: np.ndarray, y: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """Derivatives of the cross-entropy of windows ``x`` with labels ``y``, weighed by ``share``, by every table, the weights and the bias. They reach the filters only where the pooling found its maximum."""
    pooled, places = net.pooled(x)
    active = np.maximum(pooled, 0)
    error = net.probabilities(pooled)
    error[np.arange(len(x)), y] -= 1
    error *= share[:, None]
    back = (error @ net.weights.T) * (pooled > 0)
    grads = [np.zeros_like(t) for t in net.tables]
    filters = net.tables[0].shape[2]
    for k, (grad, place) in enumerate(zip(grads, places, strict=True)):
        part = back[:, k * filters : (k + 1) * filters]
        for j in range(len(grad)):
            np.add.at(grad[j], (np.take_along_axis(x, place + j, axis=1), np.arange(filters)[None, :]), part)
        grad[:, 256] = 0
    return [*grads, active.T @ error, error.sum(axis=0)]


def train(texts: list[str], labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    """Adam on cross-entropy, languages weighed equally."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels])
    x = np.concatenate([windows_of(t.encode()[:WINDOW])[0] for t in texts]).astype(np.int64)
    share = 1 / np.bincount(y, minlength=len(names))
    tables = [rng.normal(0, 0.3, (k, 257, FILTERS)).astype(np.float32) for k in WIDTHS]
    for t in tables:
        t[:, 256] = 0
    net = Network(names, tables, rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(names))).astype(np.float32), np.zeros(len(names), np.float32))
    values = [*net.tables, net.weights, net.bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 32):
            own = order[at : at + 32]
            step += 1
            for v, g, m, s in zip(values, gradients(net, x[own], y[own], share[y[own]] / share[y[own]].sum()), first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def learned(docs: DataFrame, learns: Column, sample: int = SAMPLE, window: int = WINDOW, per_text: int = PER_TEXT, epochs: int = EPOCHS) -> Network | None:
    """A network from the rows of ``docs(doc_id, text, lang)`` for which ``learns`` holds; None if there are none.

    Languages are drawn about equally, by one rule however many there are: a text is in if the hash of its id, in [0, 1), times the texts of its language
    is below 2 * sample / languages. Counts are a row a language; those of up to ``BROADCAST`` languages are sent to where the texts are.
    """
    own = docs.filter(learns & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = cut(own.groupBy("lang").count())
    n_langs = counts.count()
    if not n_langs:
        return None
    share = F.lit(2.0 * sample / n_langs)
    likely = own.withColumn("luck", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)).filter(F.col("luck") < share)
    drawn = likely.join(F.broadcast(counts) if n_langs <= BROADCAST else counts, "lang").filter(F.col("luck") * F.col("count") < share)
    parts = F.array(*[F.expr("substring(text, {}, {})".format(f"cast(floor(length(text) * {k / per_text}) as int) + 1", window)) for k in range(per_text)])
    rows = drawn.select("lang", parts.alias("parts"), F.xxhash64(F.col("doc_id"), F.lit(1)).alias("h")).orderBy("h", "lang", "parts").limit(sample).collect()
    texts = [(p, r.lang) for r in rows for p in dict.fromkeys(r.parts) if p]
    return train([t for t, _ in texts], [x for _, x in texts], epochs) if texts else None


def predictor(net: Network | None, spark: SparkSession) -> Column:
    """A pandas UDF from text to (lang_pred, score). The network is a few hundred KB, whatever the data."""
    shared = spark.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        for texts in parts:
            out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
            if net:
                # rows of windows of many texts go through the network together, in slices of bounded size
                held: list[tuple[int, np.ndarray, np.ndarray]] = []
                totals: dict[int, np.ndarray] = {}

                def flush(net: Network = net, held: list = held, totals: dict = totals) -> None:
                    windows = np.concatenate([w for _, w, _ in held])
                    owner = np.concatenate([np.full(len(w), i) for i, w, _ in held])
                    weight = np.concatenate([b for _, _, b in held])
                    p = net.probabilities(net.pooled(windows)[0]) * weight[:, None]
                    for i in dict.fromkeys(owner.tolist()):
                        totals[i] = totals.get(i, 0) + p[owner == i].sum(axis=0)
                    held.clear()

                size = 0
                for i, text in enumerate(texts):
                    if text is None or not any(map(str.isalpha, text)):
                        continue
                    windows, weight = windows_of(text.encode())
                    for at in range(0, len(windows), STEP // WINDOW):
                        part = windows[at : at + STEP // WINDOW]
                        if held and size + part.size > STEP:
                            flush()
                            size = 0
                        held.append((i, part, weight[at : at + STEP // WINDOW]))
                        size += part.size
                if held:
                    flush()
                for i, p in totals.items():
                    best = int(p.argmax())
                    out[i] = (net.labels[best], float(min(1.0, p[best] / p.sum())))
            yield pd.DataFrame(out, columns=["lang_pred", "score"])

    return predict


def held_out_of(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``, which replace columns of these names; it learns from rows that aren't held out."""
    net, both = learned(docs.select("doc_id", "text", "lang"), ~held_out_of(F.col("doc_id"))), free_name(docs, "_lang")
    out = docs.withColumn(both, predictor(net, docs.sparkSession)(F.col("text")))
    return out.withColumns({"held_out": held_out_of(F.col("doc_id")), "lang_pred": F.col(f"{both}.lang_pred"), "score": F.col(f"{both}.score")}).drop(both)


def keep_identified(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text is in some language: those without a letter go, whether or not there are labels to learn from."""
    net = learned(docs.select("doc_id", "text", "lang"), ~held_out_of(F.col("doc_id")))
    if net is None:  # every text would be ``und``
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    both = free_name(docs, "_lang")
    return docs.withColumn(both, predictor(net, docs.sparkSession)(F.col("text"))).filter(F.col(f"{both}.lang_pred") != UNKNOWN).select(*own_columns(docs))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identified(docs).select("doc_id", "held_out", "lang_pred", "score")
