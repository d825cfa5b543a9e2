"""Money, dates, times and small mathematics as column expressions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of amounts, dates and times as they are printed.
SEPARATOR_SPACE = r"(?<=\d)[ \x{A0}]*([.,])[ \x{A0}]*(?=\d{3}(?!\d))"
SPACE_GROUPED = r"(?<![\d.,:/\-])\d{1,3}(?:[ \x{A0}]+\d{3})+(?![\d:/\-]|[.,][ \x{A0}]*\d|[ \x{A0}]+\d)"
NUMBER = r"\d[\d.,]*"
DATE_WORDS = r"(?iU)(?=(ng[àa]y\s*\d{1,2}\s*th[áa]ng\s*\d{1,2}\s*n[ăa]m\s*\d{4}))"
DATE_LONG = r"(?U)(?=(?<!\d)(\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{4})(?!\d))"
DATE_SHORT = r"(?U)(?=(?<!\d)(\d{1,2}\s*[/\-.]\s*\d{1,2}\s*[/\-.]\s*\d{2})(?!\d|\s*[/\-.]\s*\d))"
TIME = r"(?U)(?<!\d)([01]?\d|2[0-3])\s*[:h]\s*([0-5]\d)(?:\s*:\s*([0-5]\d))?(?!\d)"


def _plain_digits(text: Column) -> Column:
    """The text with digits of full width as plain ones; '' for null."""
    return F.translate(F.coalesce(text, F.lit("")), "０１２３４５６７８９", "0123456789")


def parse_vnd(text: Column) -> Column:
    """Whole amount of the last number: the last separator is a decimal one if both kinds occur, or if a single one isn't
    followed by three digits; half is rounded up; k after it means thousands. Null without digits or beyond 18 digits."""
    tight = F.regexp_replace(_plain_digits(text), SEPARATOR_SPACE, "$1")
    joined = F.aggregate(F.regexp_extract_all(tight, F.lit(SPACE_GROUPED), F.lit(0)), tight, lambda s, m: F.replace(s, m, F.regexp_replace(m, r"[ \x{A0}]", "")))
    token = F.regexp_replace(F.try_element_at(F.regexp_extract_all(joined, F.lit(NUMBER), F.lit(0)), F.lit(-1)), r"[.,]+$", "")
    thousands = F.when(joined.rlike(r"(?i)\d[.,]*\s*k\b") & F.regexp(joined, F.concat(F.lit(r"(?i)\Q"), token, F.lit(r"\E\s*k\b"))), 1000).otherwise(1)
    marks = F.regexp_replace(token, r"\d", "")
    fraction = F.regexp_extract(token, r"[.,](\d*)$", 1)
    both = F.contains(marks, F.lit(".")) & F.contains(marks, F.lit(","))
    decimal = both | ((F.length(marks) == 1) & (F.length(fraction) != 3))
    digits = F.regexp_replace(token, "[.,]", "")
    whole = F.when(F.length(digits) <= 18, digits.try_cast("decimal(38,0)"))
    shifted = F.concat(F.regexp_replace(F.regexp_replace(token, r"[.,]\d*$", ""), "[.,]", ""), F.lit("."), fraction)
    rounded = F.when(F.length(digits) <= 18, F.round(shifted.try_cast("decimal(38,10)"), 0))
    return (F.when(decimal, rounded).otherwise(whole) * thousands).try_cast("bigint")


def parse_date(text: Column) -> Column:
    """ISO date, day first: the words for day, month and year, else a year of four digits, else of two (20xx); the first
    possible date of a kind counts, read from every place. Null if there is none."""

    def first(pattern: str, short: bool) -> Column:
        parts = F.transform(F.regexp_extract_all(_plain_digits(text), F.lit(pattern), F.lit(1)), lambda m: F.regexp_extract_all(m, F.lit(r"(?U)\d+"), F.lit(0)))

        def iso(p: Column) -> Column:
            day, month, year = (F.get(p, F.lit(k)) for k in range(3))
            year = F.concat(F.lit("20"), year) if short else year
            return F.try_to_timestamp(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")

        return F.try_element_at(F.filter(F.transform(parts, iso), lambda d: d.isNotNull()), F.lit(1))

    return F.date_format(F.coalesce(first(DATE_WORDS, False), first(DATE_LONG, False), first(DATE_SHORT, True)), "yyyy-MM-dd")


def parse_time(text: Column) -> Column:
    """The first time of day as HH:mm:ss; null if there is none."""
    hour, minute, second = (F.regexp_extract(_plain_digits(text), TIME, k) for k in (1, 2, 3))
    return F.when(hour != "", F.concat_ws(":", F.lpad(hour, 2, "0"), minute, F.when(second == "", "00").otherwise(second)))


def tolerance_limit(value: Column, absolute: float, relative: float) -> Column:
    return F.greatest(F.lit(float(absolute)), F.abs(value) * relative)


def logit(p: Column) -> Column:
    clipped = F.least(F.greatest(p, F.lit(1e-3)), F.lit(1 - 1e-3))
    return F.ln(clipped / (1 - clipped))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def segment_keys(code: Column, kind: str, bounds: tuple[int, ...], agree: int) -> list[Column]:
    """A key for each choice of ``agree`` of the segments of 64 bits between ``bounds``, of the kind, the choice and its bits. Two
    codes that differ in no more bits than there are segments besides ``agree`` share a key."""
    masks = [((1 << b - a) - 1) << a for a, b in zip(bounds, bounds[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [F.xxhash64(F.lit(f"{kind}{n}"), code.bitwiseAND(F.lit(signed(sum(c))))) for n, c in enumerate(itertools.combinations(masks, agree))]


#: Five segments, of which two agree for codes within 3 bits: keys of 25 bits or more.
FIVE = (0, 13, 26, 39, 52, 64)


def warmup_cosine(step: Column, total: int, warmup: float, least: float) -> Column:
    """Factor of the learning rate: linear up to ``warmup`` of all steps, then half a cosine down to ``least``."""
    rise = max(1, round(total * warmup))
    done = (step - rise) / max(1, total - rise)
    return F.when(step < rise, (step + 1) / rise).otherwise(least + (1 - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * F.least(F.lit(1.0), done))))
