"""Visually identical text with different characters.

A trie over the vocabulary is traversed with a weighted edit automaton that reads the raw characters: a character goes over an
edge of the same look at no cost, whatever its script, width or composition; characters that don't show stay at no cost, as do
blanks beside blanks and at either end; every other edit costs its weight. Texts (or their tokens) within the budget take the
vocabulary's spelling; tokens that stay unmatched are spelled by the table of shapes.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.sources.tables import spread

# Letters of other scripts and the Latin letters of the same shape, in the same order; and letters drawn like Đ.
TWINS = [
    ("АВЕЅІЈКМНОРСТҮХԚԜ", "ABESIJKMHOPCTYXQW"), ("асԁеһіјорԛѕѵԝхуӏ", "acdehijopqsvwxyl"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ονϲϳ", "ovcj"),  # Greek
    ("ՍՏՕհոսօցզ", "USOhnuogq"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHGZWVSLCPKB"),  # Cherokee
    ("ⲀⲂⲈⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬ", "ABEHIKMNOPCTYX"),  # Coptic
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɑɡÐƉ", "agĐĐ"),  # Latin
]
SAME_SHAPE = {other: latin for others, latins in TWINS for other, latin in zip(others, latins, strict=True)}
#: Kinds of compatibility mappings that change the width, the face or the joining of a letter, but not what it looks like.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

#: Vocabularies travel to every task; a larger one is refused.
MOST_PHRASES = 200_000

_HIDDEN = "\u034f\u115f\u1160\u3164\uffa0"


def shape_of(char: str) -> str:
    """What a character looks like: nothing, a blank, or base letters and marks in canonical order."""
    kind = unicodedata.category(char)
    if kind == "Cf" or char in _HIDDEN or 0xFE00 <= ord(char) <= 0xFE0F or 0xE0100 <= ord(char) <= 0xE01EF:
        return ""
    if kind == "Zs" or char.isspace():
        return " "
    tag, *parts = unicodedata.decomposition(char).split() or [""]
    letters = tag == "<compat>" and kind[0] in "LN" and all(chr(int(x, 16)).isalnum() for x in parts)  # ligatures, numerals of letters
    if tag in SAME_LOOK or letters:
        return "".join(shape_of(chr(int(x, 16))) for x in parts)
    if char in SAME_SHAPE:
        return shape_of(SAME_SHAPE[char])
    return "".join(SAME_SHAPE.get(x, x) for x in unicodedata.normalize("NFD", char))


class _Memory(dict):
    """What a function made of each key; forgets all beyond a number of keys."""

    def __init__(self, make, most: int = 100_000) -> None:
        self.make, self.most = make, most

    def __missing__(self, key: str):
        if len(self) >= self.most:
            self.clear()
        self[key] = made = self.make(key)
        return made


_SHAPES = _Memory(shape_of)
#: A character with the marks behind it, between which may be characters that don't show.
_CLUSTER = regex.compile(rf"[^\p{{M}}\uff9e\uff9f][\p{{M}}\p{{Cf}}\uff9e\uff9f{_HIDDEN}]*|[\p{{M}}\uff9e\uff9f]+")
_UNIT = regex.compile(r"\P{M}\p{M}*|\p{M}+")


def _looks(cluster: str) -> tuple[str, ...]:
    return tuple(_UNIT.findall(unicodedata.normalize("NFD", "".join([_SHAPES[c] for c in cluster]))))


#: The looks of a cluster of raw characters: none if it doesn't show, else letters, each with its marks in order.
_LOOKS = _Memory(_looks)


def looks(text: str) -> list[str]:
    """The whole text as looks, with single blanks and none at either end; what the automaton reads one by one."""
    out: list[str] = []
    for cluster in _CLUSTER.findall(text):
        for look in _LOOKS[cluster]:
            if look != " " or out and out[-1] != " ":
                out.append(look)
    return out[:-1] if out and out[-1] == " " else out


def plain_form(text: str) -> str:
    """The text spelled by the table of shapes alone."""
    return unicodedata.normalize("NFC", "".join(looks(text)))


class ShapeTrie:
    """A trie over phrases that is walked with a weighted edit automaton.

    ``budget`` is the highest cost of a match, ``weights`` the cost of a substitution by (look read, look of the edge).
    Equal looks cost nothing; other substitutions without a weight, insertions and deletions cost 1; what doesn't show and
    superfluous blanks are inserted for nothing. A state is a node of the trie, or its complement if blanks have been read
    behind it that no edge takes: such a state may end the text but not go on for nothing.
    """

    def __init__(self, phrases: Iterable[str], budget: float = 0.0, weights: dict[tuple[str, str], float] | None = None) -> None:
        self.budget, self.weights = budget, weights or {}
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[str]] = [[]]
        self.after_blank = [True]
        for phrase in sorted(set(phrases)):
            at = 0
            for look in looks(phrase):
                if look not in self.next[at]:
                    self.next[at][look] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.after_blank.append(look == " ")
                at = self.next[at][look]
            self.ends[at].append(phrase)

    def _deletions(self, states: dict[int, float]) -> dict[int, float]:
        todo = [(at, cost) for at, cost in states.items() if at >= 0]
        while todo:
            at, cost = todo.pop()
            if cost + 1 <= self.budget:
                for child in self.next[at].values():
                    if cost + 1 < states.get(child, self.budget + 1):
                        states[child] = cost + 1
                        todo.append((child, cost + 1))
        return states

    def _read(self, states: dict[int, float], look: str) -> dict[int, float]:
        """The states after one look, each with its least cost."""
        after: dict[int, float] = {}
        for at, cost in states.items():
            if at < 0 and look == " ":
                steps = [(at, cost)]
            elif at < 0:  # the blanks before are one insertion, and the look is read as from the node
                steps = [(~at, cost + 2)] + [(child, cost + 1 + (0 if edge == look else self.weights.get((look, edge), 1))) for edge, child in self.next[~at].items()] if cost + 1 <= self.budget else []
            elif look == " " and self.after_blank[at]:
                steps = [(at, cost)]
            else:
                same = self.next[at].get(look)
                steps = [] if same is None else [(same, cost)]
                if look == " ":
                    steps.append((~at, cost))
                if cost + 1 <= self.budget or self.weights:
                    steps += [(at, cost + 1)] + [(child, cost + self.weights.get((look, edge), 1)) for edge, child in self.next[at].items() if edge != look]
            for to, total in steps:
                if total <= self.budget and total < after.get(to, self.budget + 1):
                    after[to] = total
        return self._deletions(after) if self.budget else after

    def match(self, text: str) -> list[tuple[float, str]]:
        """The phrases within the budget with their costs, the cheapest first, ties in order of the phrase."""
        states = self._deletions({0: 0.0})
        for cluster in _CLUSTER.finditer(text):
            for look in _LOOKS[cluster[0]]:
                states = self._read(states, look)
            if not states:
                return []
        found: dict[str, float] = {}
        for at, cost in states.items():
            for p in self.ends[at if at >= 0 else ~at]:
                found[p] = min(cost, found.get(p, cost))
        return sorted((cost, p) for p, cost in found.items())


def canonical(text: str | None, phrases: ShapeTrie, tokens: ShapeTrie) -> tuple[str | None, str | None]:
    """(canonical form, phrase or None) of one text."""
    if text is None:
        return None, None
    found = phrases.match(text)
    if found:
        return found[0][1], found[0][1]
    out = []
    for token in text.split():
        same = tokens.match(token)
        out.append(same[0][1] if same else plain_form(token))
    return " ".join(filter(None, out)), None


def _tries(phrases: list[str], budget: float) -> tuple[ShapeTrie, ShapeTrie]:
    return ShapeTrie(phrases, budget), ShapeTrie({w for p in phrases for w in p.split()})


def _checked(phrases: list[str]) -> None:
    if len(phrases) > MOST_PHRASES:
        raise ValueError(f"a vocabulary of {len(phrases)} phrases is larger than {MOST_PHRASES}")


def canonical_forms(texts: Column, phrases: list[str], budget: float = 0.0) -> Column:
    """struct<form, phrase> of each text: its one consistent form, and the phrase of the vocabulary that it looks like.

    A null text has two nulls; an empty or blank one the form ''. Equal texts are worked once in a batch. Of several phrases
    at the same cost the first in code point order is taken, so it helps if no two phrases of a vocabulary look alike.
    """
    _checked(phrases)

    @F.pandas_udf("form string, phrase string")
    def forms(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        whole, parts = _tries(phrases, budget)
        for batch in batches:
            codes, kinds = pd.factorize(batch)
            done = [canonical(t, whole, parts) for t in kinds]
            done.append((None, None))  # for nulls, whose code is -1
            yield pd.DataFrame([done[k] for k in codes], columns=["form", "phrase"], dtype=object)

    return forms(texts)


def like_phrase(texts: Column, phrases: list[str], budget: float = 0.0) -> Column:
    """The phrase of the vocabulary that each text looks like; null for a null text or none. The automaton alone, without a form
    for what it doesn't match."""
    _checked(phrases)

    @F.pandas_udf("string")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        whole = ShapeTrie(phrases, budget)
        for batch in batches:
            codes, kinds = pd.factorize(batch)
            done = [next((p for _, p in whole.match(t)), None) for t in kinds] + [None]
            yield pd.Series([done[k] for k in codes], dtype=object)

    return found(texts)


def same_look(one: Column, other: Column, phrases: list[str]) -> Column:
    """Whether two texts have one canonical form; null if either is null."""
    _checked(phrases)

    @F.pandas_udf("boolean")
    def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        whole, parts = _tries(phrases, 0.0)
        for a, b in batches:
            yield pd.Series([None if x is None or y is None else canonical(x, whole, parts)[0] == canonical(y, whole, parts)[0] for x, y in zip(a, b)], dtype=object)

    return same(one, other)


def phrase_list(phrases: DataFrame, column: str = "phrase") -> list[str]:
    """The vocabulary of a small table; refused beyond ``MOST_PHRASES``."""
    rows = phrases.select(column).where(F.col(column).isNotNull()).distinct().limit(MOST_PHRASES + 1).collect()
    if len(rows) > MOST_PHRASES:
        raise ValueError(f"more than {MOST_PHRASES} phrases")
    return sorted(r[0] for r in rows)


def disguised(lines: DataFrame, corrections: DataFrame, phrases: list[str]) -> DataFrame:
    """(src, row_key): lines that look like a phrase, and corrections whose two texts look alike, without being the same.

    ``lines`` has row_key and text, ``corrections`` row_key, old_text and new_text; nulls are no case, repeats count once.
    """
    seen = spread(lines.where("text is not null").select("row_key", "text")).select("row_key", "text", like_phrase(F.col("text"), phrases).alias("p"))
    a = seen.where("p is not null and p <> text").select(F.lit("ocr_lines").alias("src"), F.col("row_key").cast("bigint"))
    both = corrections.where("old_text is not null and new_text is not null and old_text <> new_text")
    b = both.where(same_look(F.col("old_text"), F.col("new_text"), phrases)).select(F.lit("label_corrections").alias("src"), F.col("row_key").cast("bigint"))
    return a.union(b).distinct()
