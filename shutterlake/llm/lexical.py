"""Exact ranked lexical search by hashed max-sketches.

Method. ``index`` reads every text once. A document's row holds its distinct terms and how often each occurs, and a sketch: ``WIDTH`` coordinates, where each
term's occurrences go to the coordinate of its hash and the largest stays. A term's impact rises with its occurrences in one
document, so the coordinate's impact is the largest of all terms folded into it, whatever the collection's mean length turns out to be; the index
depends on no statistic of the collection and can be appended to. Document frequencies are summed by task first, so that no frequent term is gathered.

``search`` takes the queries in batches of bounded size. A batch's weights, folded onto the same coordinates, are multiplied by the impacts of all sketches of a
block: an upper bound of every document's score for every query. Two passes: the first scores exactly, of each block, only the
documents with the ``k`` highest bounds of a query; the k-th best of all those scores is the query's threshold. The second goes down each block by falling bounds and scores exactly
until a bound falls below the threshold or below the k-th score that the task itself has seen; a document that is opened for one query is scored for its whole batch. A task passes on at most ``k`` rows a query, and the
best of them are chosen by salted groups first.

Scores are 64-bit integers: the sum over a query's terms, repeats included, of weight * (10^9 tf div (1000 tf + 8 m)) with m = 25 + 75 n N div L.

Defined cases: a null text, or one without a term, is no document of the collection and has no score; a query without a
term that occurs has no rows. Repeated rows are documents of their own, as repeated queries are queries of their own. Equal scores go by ascending id,
null ids last; ids are integers. Texts are read whole, whatever their length. An empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.llm.mixing import running
from shutterlake.session import cut, written
from shutterlake.sources.tables import read_table

#: Coordinates of a sketch.
WIDTH = 4096
#: Terms whose document frequencies a task holds before it passes them on.
HELD = 200_000
#: A batch of queries has so many terms and queries at most, but a query of more terms is a batch of its own.
TERMS, QUERIES = 8192, 256
#: Documents of a block.
BLOCK = 1024
#: Occurrences from here on count as without end in a sketch.
MOST = 255
_CAP = 1_000_000  # no impact is above it
#: Groups in which the best rows of tasks are chosen first.
SALTS = 256

_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but ASCII characters that are no letters or digits, with A-Z in lower case, of UTF-8 bytes."""
    return (text or b"").translate(_LOWER).split()


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """A table in the shared folder with two kinds of row: documents (``n``, ``terms``, ``times``, ``sketch``), and parts of a term's document frequency (``term``, ``df``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def frequencies(least: int) -> Iterator[pa.RecordBatch]:
            if len(held) > least:
                nothing = {c: pa.nulls(len(held), k) for c, k in kinds.items() if c not in ("term", "df")}
                yield pa.RecordBatch.from_pydict({**nothing, "term": pa.array(list(held), pa.binary()), "df": pa.array(list(held.values()), pa.int64())}, pa.schema(list(kinds.items())))
                held.clear()

        kinds = {"id": pa.int64(), "n": pa.int64(), "terms": pa.binary(), "times": pa.binary(), "sketch": pa.binary(), "term": pa.binary(), "df": pa.int64()}
        for batch in batches:
            kinds["id"] = batch.schema.field(0).type
            for at in range(0, batch.num_rows, BLOCK):
                part, rows = batch.slice(at, BLOCK), []
                for k, text in enumerate(part.column(1)):
                    all_terms = terms_of(text.as_py())
                    if not all_terms:
                        continue
                    counts = Counter(all_terms)
                    held.update(counts.keys())
                    times = np.fromiter(counts.values(), "<u4", len(counts))
                    sketch = np.zeros(width, np.uint8)
                    np.maximum.at(sketch, np.fromiter(map(crc32, counts), np.int64, len(counts)) % width, np.minimum(times, MOST).astype(np.uint8))
                    rows.append((k, len(all_terms), b" ".join(counts), times.tobytes(), sketch.tobytes()))
                if rows:
                    places, *columns = zip(*rows, strict=True)
                    arrays = [part.column(0).take(pa.array(places)), *(pa.array(c, k) for c, k in zip(columns, [pa.int64(), *[pa.binary()] * 3], strict=True)), pa.nulls(len(rows), pa.binary()), pa.nulls(len(rows), pa.int64())]
                    yield pa.RecordBatch.from_arrays(arrays, list(kinds))
                yield from frequencies(HELD)
        yield from frequencies(0)

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    return written(rows.mapInArrow(run, f"id {kind}, n long, terms binary, times binary, sketch binary, term binary, df long"), "lexical")


def query_terms(queries: DataFrame, text_col: str = "text") -> DataFrame:
    """``(query, term, times)`` of rows with a long ``query``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(q, t, n) for q, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for t, n in Counter(terms_of(text)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 3, (pa.int64(), pa.binary(), pa.int64()), strict=True)], ["query", "term", "times"])

    return queries.select("query", F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "query long, term binary, times long")


def impact(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return 1_000_000_000 * times // (1000 * times + 8 * m)


class _Batch:
    """The queries of a batch: weight times repeats by term and query, and the same sums by coordinate."""

    def __init__(self, rows: list[tuple[int, bytes, int]], width: int):
        self.queries = sorted({q for q, _, _ in rows})
        place = {q: i for i, q in enumerate(self.queries)}
        self.rows = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
        self.used, at = np.unique([crc32(t) % width for t in self.rows], return_inverse=True)
        self.by_term = np.zeros((len(self.rows), len(self.queries)), np.int64)
        for q, t, w in rows:
            self.by_term[self.rows[t], place[q]] += w
        self.by_coordinate = np.zeros((len(self.used), len(self.queries)))
        np.add.at(self.by_coordinate, at, self.by_term)

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(documents, queries): no score is above its bound. Sums of whole numbers below 2^53 are exact in doubles; the margin covers larger ones."""
        times = sketches[:, self.used].astype(np.int64)
        most = np.where(times >= MOST, _CAP, impact(times, m[:, None]))
        return most.astype(np.float64) @ self.by_coordinate * (1 + 1e-12) + 1

    def scores(self, terms: bytes, times: bytes, m: int) -> list[int]:
        """Exact scores of a document for all queries."""
        rows = list(map(self.rows.get, terms.split(b" ")))
        held = np.array([i for i in rows if i is not None], np.int64)
        own = np.frombuffer(times, "<u4")[[k for k, i in enumerate(rows) if i is not None]].astype(np.int64)
        return (impact(own, np.int64(m)) @ self.by_term[held]).tolist()


def _scan(documents: DataFrame, batch: _Batch, k: int, n_docs: int, n_terms: int, width: int, floors: dict[int, int] | None) -> DataFrame:
    """``(query, id, score)``, at most ``k`` rows a query and task. ``floors``: scores that a query's k-th best is known to reach; without them, each block's ``k`` highest bounds are all that is scored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in batch.queries]  # heaps of (score, minus id)
        floor = [(floors or {}).get(q, 1) for q in batch.queries]
        kind = pa.int64()
        for rows in batches:
            kind = rows.schema.field(0).type
            for at in range(0, rows.num_rows, BLOCK):
                part = rows.slice(at, BLOCK)
                n = part.column(1).to_numpy()
                m = 100 - 75 + 75 * n * n_docs // n_terms
                sketches = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint8).reshape(-1, width)
                bounds = batch.bounds(sketches, m)
                scored: dict[int, list[int]] = {}
                for i, heap in enumerate(best):
                    own = bounds[:, i]
                    chosen = np.nonzero(own >= floor[i])[0]
                    if floors is None and len(chosen) > k:
                        chosen = chosen[np.argpartition(-own[chosen], k - 1)[:k]]
                    for d in chosen[np.argsort(-own[chosen], kind="stable")].tolist():
                        if own[d] < floor[i]:
                            break
                        if d not in scored:
                            scored[d] = batch.scores(part.column(2)[d].as_py(), part.column(3)[d].as_py(), int(m[d]))
                        score = scored[d][i]
                        if score < floor[i]:
                            continue
                        doc = part.column(0)[d].as_py()
                        entry = (score, doc is not None, 0 if doc is None else -doc)
                        if len(heap) < k:
                            heapq.heappush(heap, entry)
                        elif entry > heap[0]:
                            heapq.heapreplace(heap, entry)
                        if len(heap) == k:
                            floor[i] = max(floor[i], heap[0][0])
        found = [(q, -minus if there else None, score) for q, heap in zip(batch.queries, best, strict=True) for score, there, minus in heap]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), kind, pa.int64()), strict=True)], ["query", "id", "score"])

    return documents.mapInArrow(run, f"query long, id {documents.schema['id'].dataType.simpleString()}, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each query with their ``rank``, chosen in salted groups first."""
    order = [F.desc("score"), F.asc_nulls_last("id")]
    salted = found.withColumn("salt", F.pmod(F.xxhash64("id", "score"), F.lit(SALTS)))
    first = salted.withColumn("place", F.row_number().over(Window.partitionBy("query", "salt").orderBy(*order))).filter(F.col("place") <= k)
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def search(indexed: DataFrame, queries: DataFrame, k: int = 10, query_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents of ``index``'s table for each row of ``queries``."""
    spark = indexed.sparkSession
    documents = indexed.filter("n is not null").select("id", "n", "terms", "times", "sketch")
    n_docs, n_terms = documents.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    asked = written(queries.select(F.monotonically_increasing_id().alias("query"), F.col(query_col).alias("key"), F.col(text_col).alias("text")), "queries")
    terms = cut(query_terms(asked))
    df = indexed.filter("term is not null").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weighed = cut(terms.join(df, "term").select("query", "term", (weight * F.col("times")).cast("long").alias("weight")).filter("weight > 0"))
    sizes = running(weighed.groupBy("query").agg(F.count("*").alias("terms")).withColumn("one", F.lit(1)), ["query"], {"until": "terms", "place": "one"})
    number = F.array(F.floor((F.col("until") - F.col("terms")) / TERMS), F.floor((F.col("until") - 1) / TERMS), F.floor((F.col("place") - 1) / QUERIES))
    batches = cut(sizes.select("query", number.alias("batch")))
    schema = f"query long, rank int, id {indexed.schema['id'].dataType.simpleString()}, score long"
    out = spark.createDataFrame([], schema)
    for (own,) in batches.select("batch").distinct().orderBy("batch").toLocalIterator():
        asking = batches.filter(F.col("batch") == F.array(*map(F.lit, own))).select("query")  # QUERIES at most
        rows = weighed.join(F.broadcast(asking), "query").select("query", "term", "weight").collect()
        batch = _Batch([(q, bytes(t), w) for q, t, w in rows], width)
        seen = _ranked(_scan(documents, batch, k, n_docs, n_terms, width, None), k)
        floors = dict(seen.filter(F.col("rank") == k).select("query", "score").collect())
        out = out.unionByName(_ranked(_scan(documents, batch, k, n_docs, n_terms, width, floors), k))
    return out.join(asked.select("query", "key"), "query").select(F.col("key").alias(query_col), "rank", F.col("id").alias(id_col), "score")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(index(read_table(spark, sf_dir, "documents")), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS doc, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), n AS (SELECT doc, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM n),
t AS (SELECT doc, term, count(*)::BIGINT AS tf FROM (SELECT doc, unnest(terms) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM t, c GROUP BY term, docs),
q AS (
  SELECT item, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS item, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
  ) GROUP BY ALL
), s AS (
  SELECT q.item, q.item_id, n.doc_id, sum(q.times * f.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * (25 + (75 * n.n * c.docs) // c.total))))::BIGINT AS score
  FROM q JOIN f USING (term) JOIN t USING (term) JOIN n USING (doc), c GROUP BY q.item, q.item_id, n.doc, n.doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
"""
