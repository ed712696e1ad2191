"""Words of texts that may be misread, and keywords inside words: small helpers of tasks that look at each distinct word once."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distinct words that a task remembers.
CACHED = 300_000
#: Letters up to which a word is remembered.
LONGEST = 40
#: Between words, as in ``scalars.fuzzy_words``.
MARKS = re.compile(r"""[\s,.:;!?'"()\[\]{}/\-_]+""", re.ASCII)


def words_of(low: str) -> list[str]:
    """What ``scalars.fuzzy_words`` gives."""
    return [w for w in MARKS.split(low) if len(w) >= 3]


def remembered(f: Callable) -> Callable:
    """``f`` of a word, made once a word by a task."""
    known: dict = {}

    def of(word: str):
        if (x := known.get(word)) is None:
            if len(known) >= CACHED:
                known.clear()
            x = f(word)
            if len(word) <= LONGEST:
                known[word] = x
        return x

    return of


def near(a: str, b: str, most: int, part: bool = False) -> bool:
    """Whether ``most`` edits or fewer turn ``a`` into ``b``, or, ``part``, into a beginning of it."""
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    if part and not a:
        return True
    if len(a) - len(b) > most or not part and len(b) - len(a) > most:
        return False
    if not a or not b:
        return True
    # the first letters differ, so there is an edit at this place
    return most > 0 and (near(a[1:], b[1:], most - 1, part) or near(a[1:], b, most - 1, part) or near(a, b[1:], most - 1, part))


def misread(keywords: Sequence[tuple[str, int]]) -> Callable[[str], int]:
    """From a lower-case text to bits: which of ``keywords``, each with the most edits, ``scalars.fuzzy_includes`` finds in it; 63 at most, of three letters or more."""
    known = [(1 << i, k, min(2, most) if len(k) >= 8 else 1 if len(k) >= 5 else 0, k.count(" ") + 1, [set(k[:n]) for n in range(len(k) + 1)]) for i, (k, most) in enumerate(keywords)]

    def look(word: str) -> tuple[int, tuple]:
        bits, begins, letters, size = 0, [], set(word), len(word)
        for bit, k, most, parts, own in known:
            # each letter that the keyword, or its beginning, lacks is an edit
            if most and abs(size - len(k)) <= most and len(letters - own[-1]) <= most and near(word, k, most):
                bits |= bit
            if parts > 1 and size + 4 * (parts - 1) <= len(k) + most and len(letters - own[min(len(k), size + most)]) <= most and near(word, k, most, True):
                begins.append((bit, k, most, parts, len(k) - parts + 1, own[-1]))
        return bits, tuple(begins)

    seen = remembered(look)

    def found(low: str) -> int:
        words, bits = words_of(low), 0
        for bit, k, *_ in known:
            if k in low:
                bits |= bit
        for at, word in enumerate(words):
            own, begins = seen(word)
            bits |= own
            for bit, k, most, parts, letters, has in begins:
                if not bits & bit and abs(sum(map(len, run := words[at : at + parts])) - letters) <= most and len(run) == parts and len(set(run[-1]) - has) <= most and near(" ".join(run), k, most):
                    bits |= bit
        return bits

    return found


def misread_bits(low: Column, keywords: Sequence[tuple[str, int]]) -> Column:
    """``misread`` of a lower-case text, a long; null of null."""

    @F.pandas_udf("long")
    def bits(texts: pd.Series) -> pd.Series:
        found = misread(keywords)
        return pd.Series([None if x is None else found(x) for x in texts], dtype="Int64")

    return bits(low)


def shortened(word: str) -> set[str]:
    """A word and what is left of it without one of its letters. Two words of one edit or less share one of these."""
    return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}


def one_edit(keywords: Sequence[str], least: int) -> Callable[[list[str]], set[str]]:
    """From the words of a text to those of ``keywords``, of ``least`` letters or more, that a word, or a run of as many words as the keyword has, is but for one edit."""
    table: dict[str, list[str]] = {}
    long = [k for k in keywords if len(k) >= least]
    for k in long:
        for x in shortened(k):
            table.setdefault(x, []).append(k)
    longest = max(map(len, long), default=0) + 1
    # an edit touches one word of a run, so the first or the last is as in the keyword
    firsts: dict[str, set[int]] = {}
    lasts: dict[str, set[int]] = {}
    for k in keywords:
        parts = k.split(" ")
        if len(parts) > 1:
            firsts.setdefault(parts[0], set()).add(len(parts))
            lasts.setdefault(parts[-1], set()).add(len(parts))

    def look(word: str) -> tuple[str, ...]:
        return tuple({k for x in shortened(word) for k in table.get(x, ()) if near(word, k, 1)}) if len(word) <= longest else ()

    seen = remembered(look)

    def found(words: list[str]) -> set[str]:
        out = {k for w in set(words) for k in seen(w)}
        for at, word in enumerate(words):
            spans = [(at, n) for n in firsts.get(word, ())] + [(at - n + 1, n) for n in lasts.get(word, ())]
            for x, n in spans:
                if 0 <= x and x + n <= len(words):
                    out.update(k for k in look(" ".join(words[x : x + n])) if k.count(" ") + 1 == n)
        return out

    return found


def held_words(keywords: Sequence[str]) -> Callable[[str], set[str]]:
    """From a text to those of ``keywords`` that stand anywhere in it, also inside words."""
    plain = {k for k in keywords if " " not in k}
    spaced, sizes = sorted(set(keywords) - plain), sorted({len(k) for k in plain})

    def look(word: str) -> tuple[str, ...]:
        return tuple({x for n in sizes for i in range(len(word) - n + 1) if (x := word[i : i + n]) in plain})

    seen = remembered(look)
    return lambda text: {k for w in set(text.split(" ")) for k in seen(w)} | {k for k in spaced if k in text}
