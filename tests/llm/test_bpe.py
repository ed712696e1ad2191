import hashlib
import json
import random

from tokenizers import Tokenizer

from shutterlake.llm.bpe import Pieces, decoded, encoded, round_trip, unpacked, vocabulary_path
from shutterlake.llm.token_counts import EDITS, GROUP, PieceTree, apply_edits, build_trees

WORDS = ["Hello", " it's", "we'll", "  ", "\n\n", "\t x", "naïve", "Straße", "日本語", "😀", "á", "１２３", "٣", "Ᲊ", "\xa0", " ", "—", "€5", "<|endoftext|>", "<|end", "'", "''ve", "x" * 300, "aaaa", " 2024", "!?", "‍", "\x00", "²", "ǅ", "\x1c"]


def texts(n=120):
    rng = random.Random(5)
    return [None, "", " ", *["".join(rng.choice(WORDS) + rng.choice(["", " ", "  "]) for _ in range(rng.randint(1, 40))) for _ in range(n)]]


def test_ids_and_round_trip_equal_the_library(spark):
    tok = Tokenizer.from_file(vocabulary_path())
    own = texts() + ["ab" * 20_000, "the same text", "the same text"]
    df = spark.createDataFrame([(i, t, "ids") for i, t in enumerate(own)], "doc_id long, text string, ids_sha256 string")
    got = {r.doc_id: r for r in decoded(encoded(df)).select("doc_id", unpacked("ids").alias("ids"), "decoded").collect()}
    for i, t in enumerate(own):
        want = tok.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want, repr(t)[:80]
        assert got[i].decoded == tok.decode(want, skip_special_tokens=False) == (t or "")
    assert {(r.doc_id, r.decoded) for r in round_trip(df).collect()} == {(i, t or "") for i, t in enumerate(own)}
    assert encoded(df.limit(0)).count() == 0 and round_trip(df.limit(0)).count() == 0


def test_every_latin_character_is_cut_as_by_the_library():
    with open(vocabulary_path()) as f:
        pieces = Pieces(f.read())
    for c in [*range(0x250), *range(0x2000, 0x206F), *range(0x20A0, 0x20B6)]:
        text = f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}? {chr(c)}{chr(c)} x"
        assert not pieces.unknown.search(text), hex(c)
        assert pieces.split(text) == [text[a:b] for _, (a, b) in pieces.slow(text)], hex(c)


def test_counts_after_edits_equal_full_recounts(spark):
    tok, rng = Tokenizer.from_file(vocabulary_path()), random.Random(9)
    rows, want = [], {}
    for i, t in enumerate([*texts(80), "word " * 3000]):
        edits, now = [], t or ""
        for _ in range(rng.randint(0, 12)):
            pos, cut, put = rng.randint(-2, len(now) + 3), rng.randint(-1, 12), "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 3)))
            edits.append((pos, cut, put))
            p = max(0, min(pos, len(now)))
            now = now[:p] + put + now[p + max(0, cut) :]
        rows.append((i, t, edits or None))
        want[i] = (now, len(tok.encode(now, add_special_tokens=False).ids))
    df = spark.createDataFrame(rows, f"doc_id long, text string, edits {EDITS}")
    for r in apply_edits(build_trees(df)).collect():
        assert (r.text, r.tree.n_tokens, r.tree.n_chars) == (*want[r.doc_id], len(want[r.doc_id][0]))
    assert apply_edits(build_trees(df.limit(0))).count() == 0


def test_few_pieces_are_encoded_anew(spark):
    df = spark.createDataFrame([(1, "some words here " * 5000, [(40_000, 3, "x"), (41_000, 0, "y"), None, (None, None, None)])], f"doc_id long, text string, edits {EDITS}")
    row = apply_edits(build_trees(df)).first()
    assert row.reencoded < 60 and hashlib.sha256(row.text.encode()).hexdigest()


def test_crowded_leaf_is_spread_out(spark):
    edits = [(50, 0, f" n{k}") for k in range(600)]
    df = spark.createDataFrame([(1, "some words here " * 50, edits)], f"doc_id long, text string, edits {EDITS}")
    row = apply_edits(build_trees(df)).first()
    assert row.tree.n_tokens == len(Tokenizer.from_file(vocabulary_path()).encode(row.text, add_special_tokens=False).ids)


def test_counts_side_by_side_equal_the_heap():
    with open(vocabulary_path()) as f:
        pieces = Pieces(f.read())
    own = [x for t in texts(200) if t for x in pieces.split(t)] + ["a" * n for n in range(1, 60)] + [" internationalisation", "\0\0\0"]
    for _ in range(2):  # afresh, and from what is known
        assert pieces.counts_of(own).tolist() == [len(pieces.merged(x)) for x in own]
    assert pieces.counts_of([]).tolist() == []


def test_special_tokens_of_another_vocabulary(tmp_path, spark):
    with open(vocabulary_path()) as f:
        data = json.load(f)
    for k, token in enumerate(["[A MARK OF MORE THAN SIXTEEN LETTERS]", "<s>", "<sub>"]):
        data["added_tokens"].append({"id": 50_257 + k, "content": token, "special": True, "lstrip": False, "rstrip": False, "single_word": False, "normalized": False})
    path = str(tmp_path / "other.json")
    with open(path, "w") as f:
        json.dump(data, f)
    tok = Tokenizer.from_file(path)
    mark = "[A MARK OF MORE THAN SIXTEEN LETTERS]"
    own = [f"a{mark}b<s>c<sub>d<|endoftext|>", mark * 2, "no marks [A MARK", "<", "<su<sub>b>"]
    for r in encoded(spark.createDataFrame(list(enumerate(own)), "doc_id long, text string"), path=path).select("doc_id", unpacked("ids").alias("ids")).collect():
        assert r.ids == tok.encode(own[r.doc_id], add_special_tokens=False).ids
    # an edit at either end of a long mark makes and breaks it
    edits = [(len("one ") + len(mark) - 1, 1, ""), (len("one ") + len(mark) - 1, 0, "]"), (4, 1, "("), (4, 1, "[")]
    for n in range(1, len(edits) + 1):
        df = spark.createDataFrame([(1, f"one {mark} two", edits[:n])], f"doc_id long, text string, edits {EDITS}")
        r = apply_edits(build_trees(df, path=path), path=path).first()
        assert r.tree.n_tokens == len(tok.encode(r.text, add_special_tokens=False).ids), n


def test_repeated_rows_and_columns_of_the_results_names(spark):
    row = (1, "some words", [(0, 0, "new ")], "mine", 7, "kept")
    df = spark.createDataFrame([row, row], f"doc_id long, text string, edits {EDITS}, tree string, reencoded int, note string")
    got = apply_edits(build_trees(df)).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0].note == "kept"
    assert got[0].tree.n_chars == len("new some words") and got[0].reencoded > 0


def test_inner_sums_are_kept_and_hold(spark):
    edits = [(p, 3, "abc def ") for p in range(0, 4000, 97)]
    df = spark.createDataFrame([(1, "these are some words here " * 300, edits)], f"doc_id long, text string, edits {EDITS}")
    tree = apply_edits(build_trees(df)).first().tree
    own = PieceTree.read(tree.n_pieces, tree.leaves, tree.sums)
    assert own.size >= 8 and own.total == (tree.n_chars, tree.n_tokens, tree.n_pieces)
    assert (own.sums[:, 1 : own.size] == own.sums[:, 2::2] + own.sums[:, 3::2]).all()
    ends = own.leaves.sum(axis=1)
    assert own.total[:2] == tuple(ends.tolist()) and own.leaves.shape[1] == tree.n_pieces > 10 * GROUP
    for pos in range(0, tree.n_chars, 50):  # descending finds what a scan finds
        g, k, start = own.find(pos)
        before = [own.group(x) for x in range(g)] + [own.group(g)[:, :k]]
        assert sum(int(x[0].sum()) for x in before) == start <= pos < start + int(own.group(g)[0, k])
