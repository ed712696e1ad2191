"""Exact duplicates by deterministic block naming.

Method. Each text is cut into blocks of ``BLOCK`` bytes. Equal blocks are found by sorting them and get one integer name; then, level by
level, adjacent names of a document are paired and the sorted distinct pairs get integer names, until one name is left.
Level and name identify a text without collisions: equal texts, and only those, share them. No hash decides anything.

A task first names the blocks it sees itself, each once, so that the bytes of a block that many rows share cross the network once
a task; from then on only integers move. Names are read from tables in the shared folder, so a lost executor changes none.

Defined cases: a null text counts as empty, and empty texts are equal. Of equal texts the row with the largest id stays; nulls are
the least ids; of rows equal in id too, one stays. Every row is returned, repeated ones as often as they occur. An empty
table gives an empty result; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.names import free_name, own_columns
from shutterlake.session import cut, written
from shutterlake.sources.tables import read_table

BLOCK = 8192
#: Bytes of blocks that a task remembers before it starts to name anew.
HELD = 32 << 20


def _blocks(docs: DataFrame, block: int) -> DataFrame:
    """Two kinds of row: what document ``row`` has at ``idx`` (a local name), and the bytes of each local name."""

    def split(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known: dict[bytes, int] = {}
        held, fresh = 0, TaskContext.get().partitionId() << 33  # local names of a task are its own
        for frame in frames:
            refs, named = [], []
            for row, key, text in zip(frame["row"], frame["id"], frame["text"], strict=True):
                data = (text or "").encode()
                digest = hashlib.sha256(data).hexdigest()
                parts = [data[i : i + block] for i in range(0, len(data), block)] or [b""]
                for i, part in enumerate(parts):
                    if (name := known.get(part)) is None:
                        name = known[part] = fresh
                        fresh += 1
                        held += len(part)
                        named.append((name, part))
                    refs.append((row, i, name, len(parts), None if key is None else int(key), digest if i == 0 else None))
            if held > HELD:
                known, held = {}, 0
            out = pd.DataFrame(refs, columns=["row", "idx", "local", "n", "id", "sha"], dtype=object)
            yield pd.concat([out, pd.DataFrame(named, columns=["local", "block"], dtype=object)], ignore_index=True)

    return docs.mapInPandas(split, "row long, idx long, local long, n long, id long, sha string, block binary")


def _named(blocks: DataFrame) -> DataFrame:
    """``(local, name)``: equal blocks, sorted side by side, get one name."""

    def name(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        last, at = None, TaskContext.get().partitionId() << 33
        for frame in frames:
            names = []
            for block in frame["block"]:
                if block != last:
                    last, at = block, at + 1
                names.append(at)
            yield pd.DataFrame({"local": frame["local"], "name": names})

    return blocks.repartition("block").sortWithinPartitions("block", "local").mapInPandas(name, "local long, name long")


def duplicate_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, block: int = BLOCK) -> DataFrame:
    """``(row, doc_id, keep_id, group_size, kept, text_sha256)`` for every row. ``row_col``: a column of distinct longs, else rows are numbered here."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    table = written(_blocks(docs.select(row.alias("row"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")), block), "blocks")
    refs = table.filter("block is null")
    names = cut(_named(table.filter("block is not null").select("local", "block")))
    level, done = 0, []
    now = cut(refs.select("row", "idx", "local", "n").join(names, "local").select("row", "idx", "n", "name"))
    while True:
        done.append(now.filter("n = 1").select("row", F.lit(level).alias("level"), "name"))
        rest = now.filter("n > 1")
        if rest.isEmpty():
            break
        half = (F.col("idx") / 2).cast("long")
        side = lambda odd: F.max(F.when(F.col("idx") % 2 == odd, F.col("name")))
        pairs = rest.groupBy("row", half.alias("half"), F.ceil(F.col("n") / 2).alias("m")).agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = cut(pairs)
        names = cut(pairs.select("a", "b").distinct().repartitionByRange("a", "b").sortWithinPartitions("a", "b").withColumn("name", F.monotonically_increasing_id()))
        level += 1
        now = cut(pairs.join(names, ["a", "b"]).select("row", F.col("half").alias("idx"), F.col("m").alias("n"), "name"))
    whole = done[0]
    for part in done[1:]:
        whole = whole.unionByName(part)
    rows = cut(refs.filter("idx = 0").select("row", "id", "sha").join(whole, "row"))
    best = F.max(F.struct("id", "row"))
    classes = cut(rows.groupBy("level", "name").agg(best.alias("best"), F.count("*").alias("group_size")))
    return rows.join(classes, ["level", "name"]).select("row", F.col("id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the largest ``doc_id``."""
    row = free_name(docs, "_row")
    numbered = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    kept = duplicate_rows(numbered, row_col=row).filter("kept").select(F.col("row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*own_columns(docs))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_rows(read_table(spark, sf_dir, "documents")).drop("row")


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
