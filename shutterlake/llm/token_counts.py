"""Token counts that follow edits.

Method. Each document has a segment tree over its pre-tokens: a leaf is a group of up to ``GROUP`` of them at first and knows their characters,
tokens and number, an inner node the sums of its two children. An edit (position, characters deleted, text inserted) cuts the text anew only
from a little before the edit to the first place after it where a new cut falls on an old one; the pre-tokens between are replaced in their
group, and the sums on the way from it to the root are updated. What a pre-token is depends on the text from its start to
``Pieces.context`` characters past its end, so everything before position - context, and everything after the common cut, is as it was.

Trees are kept in a table, inner sums included: ``leaves`` has the characters and then the tokens of each pre-token in integers of the least
width that holds them, ``sums`` the three sums of every node in heap order. Only the id of a row, its text and its edits or tree pass
through Python with them.

Defined cases: a null text counts as empty, null edits as none, a null in an edit as 0 or ''. Positions and lengths beyond the
text end at its end, negative ones at 0. Edits of a document apply in their order, each to the text the last one left. Texts of any
length are taken whole. Repeated rows give equal rows, an empty table an empty result. A column that has the name of a result (``tree``,
``reencoded``) gives way to it; others pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.bpe import Pieces, mapped
from shutterlake.session import written
from shutterlake.sources.tables import read_table

#: Pre-tokens in a leaf of a new tree, and those beyond which the tree is built anew.
GROUP, CROWDED = 64, 512
EDITS = "array<struct<pos:bigint,del:bigint,ins:string>>"
CHARS, TOKENS, NUMBER = 0, 1, 2


def _narrow(values: np.ndarray) -> np.ndarray:
    most = values.max(initial=0)
    return values.astype("u1" if most < 1 << 8 else "<u2" if most < 1 << 16 else "<u4")


class PieceTree:
    """Sums of characters, tokens and pre-tokens over groups. ``leaves``: characters and tokens of each pre-token; groups that edits have touched are in ``changed``."""

    def __init__(self, leaves: np.ndarray, sums: np.ndarray | None = None):
        self.leaves = leaves
        self.n = max(1, -(-leaves.shape[1] // GROUP)) if sums is None else 0
        self.sums = self._sums() if sums is None else sums
        self.size = self.sums.shape[1] // 2
        self.ends = np.cumsum(self.sums[NUMBER, self.size :])  # where the groups end among the leaves as they were read
        self.n = self.n or int(np.searchsorted(self.ends, self.ends[-1])) + 1
        self.changed: dict[int, np.ndarray] = {}

    def _sums(self) -> np.ndarray:
        """The root at 1, the children of k at 2k and 2k + 1, the groups from ``size`` on."""
        size = 1 << (self.n - 1).bit_length()
        out = np.zeros((3, 2 * size), np.int64)
        if self.leaves.shape[1]:
            first = np.arange(0, self.leaves.shape[1], GROUP)
            out[:2, size : size + self.n] = np.add.reduceat(self.leaves, first, axis=1, dtype=np.int64)
            out[2, size : size + self.n] = np.diff(first, append=self.leaves.shape[1])
        at = size
        while at > 1:
            out[:, at >> 1 : at] = out[:, at : 2 * at : 2] + out[:, at + 1 : 2 * at : 2]
            at >>= 1
        return out

    @property
    def total(self) -> tuple[int, int, int]:
        """Characters, tokens and pre-tokens."""
        return tuple(self.sums[:, 1].tolist())

    def group(self, g: int) -> np.ndarray:
        """Characters and tokens of the pre-tokens of a group."""
        if (own := self.changed.get(g)) is None:
            own = self.leaves[:, (self.ends[g - 1] if g else 0) : self.ends[g]]
        return own

    def find(self, pos: int) -> tuple[int, int, int]:
        """The group and place in it of the pre-token that holds character ``pos``, and where it starts; past the end: the place after the last one."""
        chars = self.sums[CHARS]
        if pos >= chars[1]:
            last = self.n - 1
            return last, self.group(last).shape[1], int(chars[1])
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if pos >= start + (here := int(chars[node])):
                start += here
                node += 1
        ends = start + np.cumsum(self.group(node - self.size)[CHARS], dtype=np.int64)
        k = int(np.searchsorted(ends, pos, side="right"))
        return node - self.size, k, int(ends[k - 1]) if k else start

    def replace(self, first: tuple[int, int], last: tuple[int, int], fresh: np.ndarray) -> None:
        """The pre-tokens from place ``first`` on and before place ``last``, both (group, place in it), give way to ``fresh``."""
        (g, k), (end, stop) = first, last
        held = np.concatenate([self.group(g)[:, :k], fresh, self.group(end)[:, stop:]], axis=1, dtype=np.int64)
        for leaf in range(g, end + 1):
            own = self.changed[leaf] = held if leaf == g else held[:, :0]
            node = leaf + self.size
            gain = np.array([own[CHARS].sum(), own[TOKENS].sum(), own.shape[1]]) - self.sums[:, node]
            while node:  # every sum above the group
                self.sums[:, node] += gain
                node >>= 1
        if held.shape[1] > CROWDED:
            self.__init__(self.flat())

    def flat(self) -> np.ndarray:
        """Characters and tokens of each pre-token in order."""
        if not self.changed:
            return self.leaves
        parts, at = [], 0
        for g, own in sorted(self.changed.items()):
            parts += [self.leaves[:, at : self.ends[g - 1] if g else 0], own]
            at = self.ends[g]
        return np.concatenate([*parts, self.leaves[:, at:]], axis=1)

    def packed(self) -> tuple[int, int, int, bytes, bytes]:
        """The totals, ``leaves`` and ``sums``, as a row of the table."""
        return (*self.total, _narrow(self.flat()).tobytes(), self.sums.astype("<u4").tobytes())

    @staticmethod
    def read(n_pieces: int, leaves: bytes, sums: bytes) -> PieceTree:
        kind = f"<u{max(1, len(leaves) // max(1, 2 * n_pieces))}"
        return PieceTree(np.frombuffer(leaves, kind).reshape(2, n_pieces), np.frombuffer(sums, "<u4").reshape(3, -1).astype(np.int64))


def edited(tree: PieceTree, text: str, pieces: Pieces, pos: int, cut: int, put: str) -> tuple[str, int]:
    """The text after one edit, with ``tree`` brought up to date; and how many pre-tokens were encoded anew."""
    pos = max(0, min(pos, len(text)))
    cut = max(0, min(cut, len(text) - pos))
    new = text[:pos] + put + text[pos + cut :]
    shift, end, context = len(put) - cut, pos + len(put), pieces.context
    *first, start = tree.find(max(0, pos - context))
    reach = 4 * context
    while True:
        limit = min(len(new), end + reach)
        at, fresh, last = start, [], None
        for piece in pieces.split(new[start:limit]):
            if at >= end:
                *place, begins = tree.find(at - shift)
                if begins == at - shift:
                    last = place
                    break
            if limit < len(new) and at + len(piece) + context > limit:
                break  # what follows could change this pre-token
            fresh.append(piece)
            at += len(piece)
        else:
            last = tree.find(len(text))[:2] if limit == len(new) else None
        if last is not None:
            break
        reach *= 4
    counts = [len(pieces.ids_of(x)) // 4 for x in fresh]
    tree.replace(tuple(first), tuple(last), np.array([list(map(len, fresh)), counts], np.int64))
    return new, len(fresh)


TREE = "struct<n_chars:bigint,n_tokens:bigint,n_pieces:bigint,leaves:binary,sums:binary>"


def _trees(rows: list[tuple[int, int, int, bytes, bytes]]) -> pa.Array:
    kinds = {"n_chars": pa.int64(), "n_tokens": pa.int64(), "n_pieces": pa.int64(), "leaves": pa.binary(), "sums": pa.binary()}
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds.values())], names=list(kinds))


def build_trees(docs: DataFrame, text_col: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` with column ``tree``: the packed leaves and sums of each text, and its totals."""

    def build(pieces: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        cuts = [pieces.split(text or "") for text in part.column(text_col).to_pylist()]
        ends = np.cumsum([0, *map(len, cuts)])
        flat = [piece for own in cuts for piece in own]  # the pre-tokens of up to SLICE texts are counted together
        both = np.stack([np.fromiter(map(len, flat), np.uint32, len(flat)), pieces.counts_of(flat)])
        return [_trees([PieceTree(both[:, a:b]).packed() for a, b in zip(ends, ends[1:], strict=False)])]

    return mapped(docs, {"tree": TREE}, path, build)


def apply_edits(trees: DataFrame, edits_col: str = "edits", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``trees`` (of ``build_trees``) with text and tree after the edits in ``edits_col``, and ``reencoded``: pre-tokens encoded for them."""

    def apply(pieces: Pieces, part: pa.RecordBatch) -> list[pa.Array]:
        texts, rows, counts = [], [], []
        kept = part.column("tree")
        held = zip(part.column(text_col).to_pylist(), *(kept.field(c).to_pylist() for c in ("n_pieces", "leaves", "sums")), part.column(edits_col).to_pylist(), strict=True)
        for text, n_pieces, leaves, sums, edits in held:
            text, n = text or "", 0
            tree = PieceTree.read(n_pieces, leaves, sums)
            for e in edits or []:
                if e is not None:
                    text, k = edited(tree, text, pieces, e["pos"] or 0, e["del"] or 0, e["ins"] or "")
                    n += k
            texts.append(text)
            rows.append(tree.packed())
            counts.append(n)
        return [pa.array(texts, pa.string()), _trees(rows), pa.array(counts, pa.int64())]

    return mapped(trees, {text_col: "string", "tree": TREE, "reencoded": "bigint"}, path, apply)


def review_edits() -> F.Column:
    """Three edits of every document, placed by its id: a reviewer's note put in, a phrase replaced, a few words struck out."""
    place = lambda k: F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(k)), F.coalesce(F.length("text"), F.lit(0)).cast("long") + 1)
    edit = lambda k, cut, put: F.struct(place(k).alias("pos"), F.lit(cut).cast("long").alias("del"), F.lit(put).alias("ins"))
    return F.array(edit(1, 0, " [it's reviewed in 2024]\n"), edit(2, 9, "re-worded"), edit(3, 40, "")).cast(EDITS)


def op1_edit_aware_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("edits", review_edits())
    # the trees are a table of their own, which edits that come later are applied to
    trees = written(build_trees(docs), "trees").withColumn("n_tokens_before", F.col("tree.n_tokens"))
    after = apply_edits(trees)
    sums = [F.col(f"tree.{c}").alias(c) for c in ("n_tokens", "n_chars", "n_pieces")]
    return after.select("doc_id", "n_tokens_before", *sums, F.col("reencoded").alias("n_reencoded"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))
