"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Method. Sources get targets by water-filling: they share ``share`` of all words by weight, no source over ``repeats`` times its
own words, the excess going to the others by weight. A source takes as many complete epochs as fit its target; the
remainder is a weighted sample without replacement: each document draws an exponential key -ln(u) / quality, u from the
digest of its id, and documents are taken in the order of their keys while the words before plus half their own stay
within the remainder. So a source ends within half a document of its target, and reruns agree.

The running sum is two-level. Words are first summed by source and key bucket; only the documents of the one bucket in which a source's
remainder ends are sorted, and those by ranges of their keys over many tasks (``running``). So neither a source with a third of all rows, nor one
whose keys nearly all fall into one bucket, nor many sources are ever gathered.

Defined cases: a null text has size 0 and is never taken; a null source is a source of its own, ordered last; equal keys are
ordered by id, size and row. Repeated rows are documents of their own. With no words at all every target is 0. An empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shutterlake.llm.names import free_name, own_columns
from shutterlake.session import cut, written
from shutterlake.sources.tables import read_table

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
#: Buckets of the exponential key; the first level of the running sum.
BUCKETS = 4096


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column) -> Column:
    """From 0.1 for nothing but ASCII marks and digits up to 1 for none of them; 1 for an empty text."""
    kept = F.length(F.regexp_replace(text, r"[!-@\[-`{-~]", "")) / F.length(text)
    return F.coalesce(F.when(F.length(text) > 0, 0.1 + 0.9 * kept), F.lit(1.0))


def exponential_key(doc_id: Column, quality: Column) -> Column:
    """-ln(u) / quality, u in (0, 1) from the first 52 bits of the id's MD5 digest."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / quality


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str], group: str | None = None) -> DataFrame:
    """``df`` with inclusive running sums ``sums`` (new name: column) in an order that has no ties, of all rows or of each ``group``.

    Rows are dealt out by ranges of the order, so equal keys and large groups spread over tasks; each range adds what the ranges before it hold.
    """
    keys = [*([group] if group else []), *order]
    parts = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    own = [group, "_part"] if group else ["_part"]
    whole = parts.groupBy(*own).agg(*[F.sum(c).alias(f"_sum_{name}") for name, c in sums.items()])  # a row for each range, and for each group in it
    earlier = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = whole.select(*own, *[F.coalesce(F.sum(f"_sum_{name}").over(earlier), F.lit(0)).alias(f"_before_{name}") for name in sums])
    same = F.col("a._part") == F.col("b._part")
    joined = parts.alias("a").join(whole.alias("b"), same & F.col(f"a.{group}").eqNullSafe(F.col(f"b.{group}")) if group else same)
    inside = Window.partitionBy(*[f"a.{c}" for c in own]).orderBy(*[f"a.{c}" for c in order]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(*[F.col(f"a.{c}") for c in df.columns], *[(F.sum(f"a.{c}").over(inside) + F.col(f"b._before_{name}")).alias(name) for name, c in sums.items()])


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """``sizes(source, source_size)``, one row a source, with ``target``. Sources may be many: their order is found by ranges, not in one task."""
    named = running(sizes.withColumns({"none": F.col("source").isNull(), "one": F.lit(1)}), ["none", "source"], {"rank": "one"})
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights)).cast("int") + 1)
    ranked = named.select("source", "source_size", "none", weight.alias("weight"), (F.col("source_size") * float(repeats)).alias("cap"))
    ranked = running(ranked.withColumn("ratio", F.col("cap") / F.col("weight")), ["ratio", "none", "source"], {"caps": "cap", "weights": "weight"})
    # what is left for a source and those of larger ratio, once those of smaller ratio have all they can take
    everything = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("total"), F.coalesce(F.sum("weight"), F.lit(0)).alias("all_weights"))
    level = (F.col("total") * float(share) - (F.col("caps") - F.col("cap"))) / (F.col("all_weights") - (F.col("weights") - F.col("weight")))
    place = F.struct("ratio", "none", "source")
    filled = cut(ranked.crossJoin(F.broadcast(everything)).withColumn("level", level).select("source", "source_size", "weight", "cap", place.alias("place"), "level"))
    # from the first source that stays under its cap on, all have its level
    first = filled.filter(F.col("place.ratio") > F.col("level")).agg(F.min(F.struct("place", "level")).alias("x")).select(F.col("x.place").alias("first"), F.col("x.level").alias("own"))
    under = F.col("place") >= F.col("first")
    return filled.crossJoin(F.broadcast(first)).select("source", "source_size", F.when(under, F.col("weight") * F.col("own")).otherwise(F.col("cap")).alias("target"))


def mixed(rows: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, buckets: int = BUCKETS) -> DataFrame:
    """``rows(row, doc_id, source, size, key)`` with ``source_size``, ``target`` and ``taken``: the words that the mix takes of each."""
    bucket = F.least(F.floor((1 - F.exp(-F.col("key"))) * buckets), F.lit(buckets - 1)).cast("int")
    rows = cut(rows.withColumn("bucket", bucket))
    goals = cut(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, repeats))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = goals.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("until", F.sum("words").over(Window.partitionBy("source").orderBy("bucket")))  # at most `buckets` rows a source
    same = F.col("s.source").eqNullSafe(F.col("g.source"))
    ends = sums.alias("s").join(goals.alias("g"), same).select("s.source", "source_size", "target", "epochs", "rest", "bucket", "until", "words")
    # the bucket in which the remainder ends, and the words before it; a remainder that takes all ends past the last one
    inside = (F.col("until") > F.col("rest")) & (F.col("until") - F.col("words") <= F.col("rest"))
    edge = ends.groupBy("source", "source_size", "target", "epochs", "rest").agg(F.min(F.when(inside, F.col("bucket"))).alias("edge"), F.min(F.when(inside, F.col("until") - F.col("words"))).alias("before"))
    edge = cut(edge.withColumn("edge", F.coalesce("edge", F.lit(buckets))))
    joined = rows.alias("r").join(edge.alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")))
    columns = ["r.row", "r.doc_id", "r.source", "size", "source_size", "target", "epochs"]
    names = [c.removeprefix("r.") for c in columns]
    at_edge = joined.filter(F.col("bucket") == F.col("edge")).select(*columns, "key", "rest", "before").toDF(*names, "key", "rest", "before")
    at_edge = running(at_edge, ["key", "doc_id", "size", "row"], {"run": "size"}, "source")
    at_edge = at_edge.withColumn("until", F.col("before") + F.col("run")).withColumn("chosen", 2 * F.col("until") - F.col("size") <= 2 * F.col("rest"))
    off_edge = joined.filter(F.col("bucket") != F.col("edge")).withColumn("chosen", F.col("bucket") < F.col("edge"))
    both = off_edge.select(*columns, "chosen").toDF(*names, "chosen").unionByName(at_edge.select(*names, "chosen"))
    return both.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("size") * (F.col("epochs") + F.col("chosen").cast("int"))).cast("long").alias("taken"))


def measured(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """The rows that ``mixed`` takes, from documents with ``doc_id``, ``source`` and ``text``."""
    row = F.monotonically_increasing_id() if row is None else row
    text = F.col("text")
    return docs.select(row.alias("row"), "doc_id", "source", size_of(text).alias("size"), exponential_key(F.col("doc_id"), quality_of(text)).alias("key"))


def mix(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: not at all, once or several times, with their own columns."""
    row, times, copy = (free_name(docs, x) for x in ("_row", "_times", "_copy"))
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mixed(measured(numbered, F.col(row))).filter("taken > 0").select(F.col("row").alias(row), (F.col("taken") / F.col("size")).cast("int").alias(times))
    return numbered.join(taken, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*own_columns(docs))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(measured(read_table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    -ln((CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0)
      / CASE WHEN length(text) > 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * (length(regexp_replace(text, '[!-@\[-`{-~]', '', 'g'))::DOUBLE / length(text)) ELSE 1.0::DOUBLE END AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM d GROUP BY source
), r AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / weight AS ratio FROM s),
l AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS level
  FROM r WINDOW b AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), o AS (
  SELECT *, first_value(CASE WHEN ratio > level THEN level END IGNORE NULLS) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS own FROM l
), t AS (SELECT source, source_size, CASE WHEN own IS NULL THEN cap ELSE weight * own END AS target FROM o),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
k AS (
  SELECT d.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size, target, (size * (epochs + CASE WHEN 2 * until - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM k
"""
