"""Reading level of each document, from smoothed unigram language models of the levels.

One model for each pair of language and level is estimated from graded samples, with words folded (shapes, accents, case,
digits), additive smoothing over the common vocabulary and one unseen word. The language of a text is taken from the models
too, so a wrong or missing label does no harm: a level's likelihood is the mean of those of its languages. A text gets the
level with the highest posterior, all levels being alike before it is read.

With ``borrowed`` above 0 a text is read as sentences each of which may with that probability be of any level, so that a few
borrowed sentences don't decide; its level is then the one with the highest likelihood of all its sentences.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.llm.lookalike import shape_of
from slipworks.sources.tables import spread

#: Graded samples that are fitted on the driver; a larger table is refused.
MOST_SAMPLES = 50_000
SMOOTHING = 0.1

_WORD = re.compile(r"[^\W\d_]+|\d+")
_WORD_OR_STOP = re.compile(r"[^\W\d_]+|\d+|[.!?;\n]")


class _Fold(dict):
    """For str.translate: shape without marks, in lower case, đ as d."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in "\n\r  ":
            plain = "\n"
        else:
            plain = "".join(c for c in shape_of(char) if unicodedata.category(c) != "Mn").lower().replace("đ", "d")
        self[code] = plain
        return plain


_FOLDED = _Fold()


def words(text: str) -> list[str]:
    """The folded words of a text; a number is the word 0."""
    return ["0" if w[0].isdigit() else w for w in _WORD.findall(text.translate(_FOLDED))]


def sentences(text: str) -> list[list[str]]:
    """The words of each sentence that has any; a number is the word 0."""
    out: list[list[str]] = [[]]
    for w in _WORD_OR_STOP.findall(text.translate(_FOLDED)):
        if w in ".!?;\n":
            if out[-1]:
                out.append([])
        else:
            out[-1].append("0" if w[0].isdigit() else w)
    return out if out[-1] else out[:-1]


class LevelModels:
    def __init__(self, samples: list[tuple[str, int, str]], smoothing: float = SMOOTHING, borrowed: float = 0.0) -> None:
        counts: dict[tuple[str, int], Counter] = {}
        for lang, level, text in samples:
            counts.setdefault((lang or "", level), Counter()).update(words(text))
        if not counts:
            raise ValueError("no graded sample has a level and a text")
        self.kinds, self.borrowed = sorted(counts), borrowed
        self.levels = sorted({level for _, level in self.kinds})
        self.rows = {w: i for i, w in enumerate(sorted(set().union(*counts.values())))}
        table = np.zeros((len(self.rows) + 1, len(self.kinds)))
        for k, kind in enumerate(self.kinds):
            for w, n in counts[kind].items():
                table[self.rows[w], k] = n
        self.log = np.log((table + smoothing) / (table.sum(axis=0) + smoothing * (len(self.rows) + 1)))
        self.of = [np.array([k for k, (_, level) in enumerate(self.kinds) if level == v]) for v in self.levels]

    def scores(self, text: str) -> np.ndarray:
        """The log likelihood of each level; equal for a text without words."""
        if self.borrowed:
            return self._by_sentence(text)
        rows, unseen = self.rows, len(self.rows)
        ids = np.array([rows.get(w, unseen) for w in words(text)], np.int64)
        kinds = self.log[ids].sum(axis=0)
        return np.array([np.logaddexp.reduce(kinds[cols]) - np.log(len(cols)) for cols in self.of])

    def _by_sentence(self, text: str) -> np.ndarray:
        parts = sentences(text)
        if not parts:
            return np.zeros(len(self.levels))
        unseen = len(self.rows)
        ids = np.fromiter((self.rows.get(w, unseen) for s in parts for w in s), np.int64)
        starts = np.cumsum([0] + [len(s) for s in parts[:-1]])
        kinds = np.add.reduceat(self.log[ids], starts, axis=0)
        levels = np.stack([np.logaddexp.reduce(kinds[:, cols], axis=1) - np.log(len(cols)) for cols in self.of], axis=1)
        posterior = np.exp(levels - levels.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        return np.log(self.borrowed / len(self.levels) + (1 - self.borrowed) * posterior).sum(axis=0)

    def level(self, text: str) -> int:
        """The level with the highest likelihood; the easiest of equals."""
        return self.levels[int(self.scores(text).argmax())]


def fit_levels(samples: DataFrame, borrowed: float = 0.0) -> LevelModels:
    """Models from the rows of ``samples`` (lang, level, text) that have a level and a text; lang may be null."""
    rows = samples.where("level is not null and text is not null").select("lang", "level", "text").limit(MOST_SAMPLES + 1).collect()
    if len(rows) > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} graded samples")
    return LevelModels([(r[0], r[1], r[2]) for r in rows], borrowed=borrowed)


def reading_level(text: Column, models: LevelModels) -> Column:
    """The level of each whole text; null for a null or blank one. A text without words gets the easiest level."""

    @F.pandas_udf("int")
    def level(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([models.level(t) if t is not None and t.strip() else None for t in batch], dtype="Int32")

    return level(text)


def documents_with_level(documents: DataFrame, samples: DataFrame) -> DataFrame:
    """(doc_id, level) of each running text that isn't null or blank."""
    prose = documents.where((F.col("layout") == "prose") & F.col("text").isNotNull()).select("doc_id", "text")
    return spread(prose).select("doc_id", reading_level(F.col("text"), fit_levels(samples)).alias("level")).where("level is not null")
