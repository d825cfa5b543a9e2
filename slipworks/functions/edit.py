"""Edit counts and corpus rates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from slipworks.functions.text import VARIANTS, whole_forms

#: Code points that stand for the distinct words of a pair: one contiguous block of CJK ideographs.
FIRST, SIZE = 0x4E00, 8192


def words_apart(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of words, a row of the table at a time."""
    code: dict[str, int] = {}
    x, y = (np.array([code.setdefault(w, len(code)) for w in words], dtype=np.int64) for words in (a, b))
    steps = np.arange(len(y) + 1)
    last = steps
    for i, w in enumerate(x, 1):
        best = np.concatenate([[i], np.minimum(last[1:] + 1, last[:-1] + (y != w))])
        last = np.minimum.accumulate(best - steps) + steps
    return int(last[-1])


@F.pandas_udf(IntegerType())
def _word_distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    return pd.Series([None if r is None or h is None else words_apart(list(r), list(h)) for r, h in zip(ref, hyp)], dtype="Int32")


def word_edit(reference: Column, hypothesis: Column) -> tuple[Column, Column]:
    """(errors, length of the reference) in words: each distinct word of the pair becomes one code point, so that the built-in
    distance applies. Both are columns of a table, in one of the forms of ``text.whole_forms``.

    Pairs of more than ``SIZE`` distinct words are measured in Arrow-batched Python; no other pair is sent there.
    """
    alphabet = F.lit("".join(map(chr, range(FIRST, FIRST + SIZE))))
    ref, hyp = (F.filter(F.split(x, " "), lambda w: w != "") for x in (reference, F.coalesce(hypothesis, F.lit(""))))
    kinds = F.array_distinct(F.concat(ref, hyp))

    def coded(words: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.substring(alphabet, F.array_position(kinds, w).cast("int"), F.lit(1))), "")

    many = F.size(kinds) > SIZE
    long = _word_distance(F.when(many, ref), F.when(many, hyp))
    return F.when(many, long).otherwise(F.levenshtein(coded(F.when(~many, ref)), coded(F.when(~many, hyp)))), F.when(ref.isNotNull(), F.size(ref))


def with_forms(df: DataFrame, reference: str, hypothesis: str) -> DataFrame:
    """Adds _ref and _hyp, structs of the whole texts in each of ``VARIANTS``; a missing hypothesis counts as empty, a missing
    reference has null forms."""
    out = df.withColumn("_r", whole_forms(F.col(reference))).withColumn("_hyp", whole_forms(F.col(hypothesis)))
    return out.withColumn("_ref", F.when(F.col(reference).isNotNull(), F.col("_r"))).drop("_r")


def score_pairs(df: DataFrame, reference: str, hypothesis: str, keep: list[str]) -> DataFrame:
    """(keep, errors and lengths in characters and words for each variant, exact_match): counts are in code points of the whole
    texts; all are null for a missing reference."""
    forms = with_forms(df.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(reference).alias("r"), F.col(hypothesis).alias("h")), "r", "h")
    out = []
    for v in VARIANTS:
        ref, hyp = F.col(f"_ref.{v}"), F.col(f"_hyp.{v}")
        for unit, (errors, length) in (("char", (F.levenshtein(ref, hyp), F.length(ref))), ("word", word_edit(ref, hyp))):
            out += [errors.alias(f"{unit}_err_{v}"), length.alias(f"{unit}_len_{v}")]
    return forms.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *out, (F.col("_ref.exact") == F.col("_hyp.exact")).cast("int").alias("exact_match"))


def rate(errors: Column, lengths: Column) -> Column:
    """Ratio of sums; null over nothing."""
    return F.sum(errors) / F.nullif(F.sum(lengths), F.lit(0))
