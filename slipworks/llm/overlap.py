"""Same or near-same photographs across splits, by similarity-hash fingerprints.

A photograph has up to three kinds of 64-bit fingerprints: the gradient hash of its image, a similarity hash of all its text,
and one of each window of text from a line with figures to a next one that is far enough to tell something, and of each line
with a number of a sale, which survive where a page is cut off. Codes are cut into segments; distinct codes of train and of the
other splits that agree in enough segments for their Hamming radius meet in a join: 2 of 5 for radius 3, 1 of 2 for radius 1.
Photographs come in behind their codes, and what is left is verified by the texts themselves. Two sales of the same goods have
alike texts too, but their shingles differ where times and numbers stand.

A window of printed phrases or round amounts is on a share of all photographs, so those that meet in it grow with the square of
the input. Sets of shingles as bits bound how many two texts can have in common; what can't pass the verification is left out
in the join where photographs meet, before pairs are rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.functions.values import FIVE, segment_keys
from slipworks.llm.lookalike import shape_of
from slipworks.llm.names import ratio
from slipworks.session import Workspace

SHINGLE, IMAGE_RADIUS, TEXT_RADIUS, WINDOW_RADIUS = 5, 3, 3, 1
#: Least shares of common shingles.
CONTAINED, JACCARD = 0.8, 0.45
#: A line with so many digits bounds a window, and a window has at least so many that aren't zeros at the end of a number:
#: round amounts with a printed phrase between them are on very many receipts and tell nothing.
LINE_DIGITS, WINDOW_DIGITS = 4, 7
#: A line without a product is a window of its own from so many such digits on, as times and numbers of a sale are, unless it
#: is an amount, which ends in 00; an amount is one only from more digits on than amounts have.
ALONE_DIGITS, ALONE_AMOUNT = 7, 9
_ROUND = re.compile(rb"0+(?![0-9])")
#: Figures and least ratio of lines that tell a sale.
MARK_DIGITS, MARK_RATIO = 6, 0.8
#: Bits of a set of shingles, and pairs of photographs that meet in one task.
SKETCH_BITS, MOST_MET = 1024, 1 << 25
#: Image hashes with fewer bits of either kind are meaningless.
LEAST_BITS = 6


class _Plain(dict):
    """For str.translate: folded letters and digits; o, l and i as the digits they are mistaken for; lines end in a bar."""

    def __missing__(self, code: int) -> str:
        if code == 10:
            plain = "|"
        else:
            plain = "".join(c for c in shape_of(chr(code)) if c.isalnum() and unicodedata.category(c) != "Mn").lower()
            plain = plain.replace("đ", "d").translate({ord("o"): "0", ord("l"): "1", ord("i"): "1"})
        self[code] = plain
        return plain


_PLAIN = _Plain()
_DIGITS = np.zeros(256, bool)
_DIGITS[48:58] = True


def plain_text(text: str) -> str:
    """Lines of folded letters and digits, each ended by a bar; lines without any are left out."""
    return re.sub(r"\|{2,}", "|", text.translate(_PLAIN)).strip("|") + "|"


def _bits(codes: np.ndarray) -> np.ndarray:
    """-1 or 1 for each of the 64 bits of each code."""
    return np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def _codes(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").reshape(-1).view(np.int64)


def shingle_codes(raw: np.ndarray) -> np.ndarray:
    """A mixed 64-bit code of each run of ``SHINGLE`` bytes."""
    n = len(raw) - SHINGLE + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        code = code << np.uint64(8) | raw[k : k + n].astype(np.uint64)
    for mult, shift in ((0xBF58476D1CE4E5B9, 30), (0x94D049BB133111EB, 27), (0x9E3779B97F4A7C15, 31)):
        code = (code ^ code >> np.uint64(shift)) * np.uint64(mult)
    return code ^ code >> np.uint64(32)


def fingerprints(text: str) -> tuple[int | None, list[int]]:
    """The similarity hash of a plain text and those of its windows; none for a text shorter than a shingle."""
    page = text.encode()
    raw = np.frombuffer(page, np.uint8)
    code = shingle_codes(raw)
    if not len(code):
        return None, []
    sums = np.zeros((len(code) + 1, 64), np.int32)
    np.cumsum(_bits(code), axis=0, out=sums[1:])
    whole = int(_codes(sums[-1:])[0])
    ends = np.flatnonzero(raw == 124)
    starts = np.concatenate([[0], ends[:-1] + 1])
    digits = np.concatenate([[0], np.cumsum(_DIGITS[raw])])
    rich = np.flatnonzero(digits[ends] - digits[starts] >= LINE_DIGITS)
    if not len(rich):
        return whole, []
    telling = np.concatenate([[0], np.cumsum(_DIGITS[np.frombuffer(_ROUND.sub(lambda m: b"o" * len(m[0]), page), np.uint8)])])
    until = np.maximum(np.searchsorted(telling[ends[rich]], telling[starts[rich]] + WINDOW_DIGITS), np.arange(len(rich)) + 1)
    kept = until < len(rich)
    products = np.concatenate([[0], np.cumsum(raw == 120)])
    amount = (raw[ends[rich] - 1] == 48) & (raw[ends[rich] - 2] == 48)  # a rich line has more than two letters
    alone = rich[(telling[ends[rich]] - telling[starts[rich]] >= np.where(amount, ALONE_AMOUNT, ALONE_DIGITS)) & (products[ends[rich]] == products[starts[rich]])]
    begin = np.concatenate([starts[rich[kept]], starts[alone]])
    end = np.minimum(np.concatenate([ends[rich[until[kept]]], ends[alone]]) + 1 - SHINGLE + 1, len(code))
    fit = end > begin
    return whole, np.unique(_codes(sums[end[fit]] - sums[begin[fit]])).tolist()


def sketch(text: str) -> tuple[int, np.ndarray]:
    """How many shingles a text has, and the set of them as ``SKETCH_BITS`` bits: a bit that only one of two texts has is a
    shingle that only that text has."""
    bits = np.zeros(SKETCH_BITS, bool)
    bits[shingle_codes(np.frombuffer(text.encode("utf-32-le"), np.uint32)) % np.uint64(SKETCH_BITS)] = True
    return len(shingles(text)), bits


def shingles(text: str) -> set[str]:
    return {text[i : i + SHINGLE] for i in range(len(text) - SHINGLE + 1)}


def sale_marks(text: str) -> list[str]:
    """Lines that can tell one sale from another: with many figures, but not an amount (which ends in 00) or a product."""
    return [line for line in text.split("|") if "x" not in line and sum(map(str.isdigit, line)) >= MARK_DIGITS and not line.endswith("00")]


class Verifier:
    """Whether two plain texts are of one sale; remembers what it made of a text, and forgets all beyond a number of texts."""

    def __init__(self, most: int = 4_000) -> None:
        self.most, self.known = most, {}

    def _of(self, text: str) -> tuple[list[str], set[str]]:
        if text not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[text] = sale_marks(text), shingles(text)
        return self.known[text]

    def same(self, a: str, b: str) -> bool:
        """Whether most shingles of the shorter text are in the other, enough of both are common, and, where both state a time
        or number of the sale, one of them is about the same."""
        (marks, x), (others, y) = self._of(a), self._of(b)
        both = len(x & y)
        if not both or both < CONTAINED * min(len(x), len(y)) or both < JACCARD * (len(x) + len(y) - both):
            return False
        return not marks or not others or any(ratio(m, o) >= MARK_RATIO for m in marks for o in others)


def same_text(a: str, b: str) -> bool:
    return Verifier().same(a, b)


#: Segments of 64 bits by kind of fingerprint, and how many of them agree within its radius: 3 wrong bits leave 2 of 5 right,
#: 1 wrong bit leaves 1 of 2.
SEGMENTS = {"i": (FIVE, 2), "t": (FIVE, 2), "w": ((0, 32, 64), 1)}
RADIUS = {"i": IMAGE_RADIUS, "t": TEXT_RADIUS, "w": WINDOW_RADIUS}


def _keys(code: Column, kind: str) -> list[Column]:
    return segment_keys(code, kind, *SEGMENTS[kind])


def photographs(lines: DataFrame, manifest: DataFrame, work: Workspace) -> DataFrame:
    """(image_id, train, image, text, code, windows) of the photographs of the splits train, val, test and test_seen.

    ``lines`` has image_id, line_no and text, ``manifest`` image_id, split and image_hash; rows sent twice count once.
    """
    name = F.lower(F.regexp_replace("split", r"(?U)\s+", ""))
    known = manifest.where("image_id is not null").select("image_id", name.alias("s"), "image_hash").where(F.col("s").isin("train", "val", "test", "test_seen"))
    known = known.groupBy("image_id").agg((F.min("s") == "train").alias("train"), F.max("image_hash").alias("image"))
    pages = lines.where("image_id is not null and text is not null").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("page"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [plain_text(p) if p else "|" for p in batch["page"]]
            prints = [fingerprints(t) for t in texts]
            yield batch[["image_id", "train", "image"]].assign(text=texts, code=pd.array([c for c, _ in prints], dtype="Int64"), windows=pd.Series([w for _, w in prints], index=batch.index, dtype=object))

    rows = known.join(pages, "image_id", "left").mapInPandas(run, "image_id string, train boolean, image long, text string, code long, windows array<long>")
    return work.write(rows, "photographs")[0]


def _codes_of(photos: DataFrame) -> DataFrame:
    """(image_id, train, kind, print): every fingerprint of every photograph; image hashes that mean nothing are left out."""
    image = F.when(F.bit_count("image").between(LEAST_BITS, 64 - LEAST_BITS), F.col("image"))
    one = lambda kind, code: F.when(code.isNotNull(), F.array(F.struct(F.lit(kind).alias("kind"), code.alias("print"))))
    windows = F.transform(F.col("windows"), lambda w: F.struct(F.lit("w").alias("kind"), w.alias("print")))
    each = F.array_compact(F.array(one("i", image), one("t", F.col("code")), windows))
    return photos.select("image_id", "train", F.explode(F.flatten(each)).alias("c")).select("image_id", "train", "c.*")


def near_codes(codes: DataFrame) -> DataFrame:
    """(kind, p1, p2): distinct fingerprints of train and of others within the radius of their kind.

    ``codes`` has train, kind and print. Equal codes are one row here however many photographs have them.
    """
    distinct = codes.select("train", "kind", "print").distinct()
    keys = F.when(F.col("kind") == "w", F.array(*_keys(F.col("print"), "w"))).when(F.col("kind") == "t", F.array(*_keys(F.col("print"), "t"))).otherwise(F.array(*_keys(F.col("print"), "i")))
    keyed = distinct.select("train", "kind", "print", F.explode(keys).alias("key"))
    left, right = keyed.where("train").select("key", "kind", F.col("print").alias("p1")), keyed.where("not train").select("key", "kind", F.col("print").alias("p2"))
    apart, radius = F.bit_count(F.col("p1").bitwiseXOR(F.col("p2"))), F.lit(None)
    for kind, r in RADIUS.items():
        radius = F.when(F.col("kind") == kind, r).otherwise(radius)
    return left.join(right, ["key", "kind"]).where(apart <= radius).select("kind", "p1", "p2").distinct()


_SKETCH = [f"s{k}" for k in range(SKETCH_BITS // 64)]


def _sketches(photos: DataFrame) -> DataFrame:
    """(image_id, size, spare, and the words of the sketch): shingles, and how many of them share a bit with others; size and
    spare are null without a text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [sketch(t or "") for t in batch["text"]]
            bits = np.array([b for _, b in made], bool).reshape(-1, SKETCH_BITS)
            out = pd.DataFrame(np.packbits(bits, axis=1, bitorder="little").view(np.int64), columns=_SKETCH, index=batch.index)
            size = pd.Series([n for n, _ in made], index=batch.index, dtype="Int64").mask(batch["text"].isna())
            yield pd.concat([batch[["image_id"]].assign(size=size, spare=size - bits.sum(axis=1)), out], axis=1)

    texts = photos.select("image_id", F.nullif("text", F.lit("|")).alias("text"))
    return texts.mapInPandas(run, f"image_id string, size long, spare long, {', '.join(f'{c} long' for c in _SKETCH)}")


def _may_be_same() -> Column:
    """Whether the sketches of x and y leave it open that ``Verifier.same`` holds; without a text of either they do."""
    both = sum((F.bit_count(F.col(f"x.{c}").bitwiseAND(F.col(f"y.{c}"))) for c in _SKETCH), F.lit(0))
    most, sizes = F.least(F.col("x.spare"), F.col("y.spare")) + both, (F.col("x.size"), F.col("y.size"))
    may = (most > 0) & (most >= CONTAINED * F.least(*sizes)) & (most >= JACCARD * (sizes[0] + sizes[1] - most))
    return sizes[0].isNull() | sizes[1].isNull() | may


def candidates(photos: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(a, b, image): photographs of train and of another split that are within the radius of one kind of fingerprint and whose
    texts may be of one sale, and whether their images are within it.

    A fingerprint of very many photographs is met in parts: those of train are dealt to the parts, the others are in each.
    """
    work = work or Workspace(photos.sparkSession, "candidates")
    codes, _ = work.write(_codes_of(photos), "codes")
    near, _ = work.write(near_codes(codes), "near")
    sketches, _ = work.write(_sketches(photos), "sketches")
    ones = codes.where("train").select("kind", F.col("print").alias("p1"), "image_id")
    others = codes.where("not train").select("kind", F.col("print").alias("p2"), "image_id")
    left, _ = work.write(near.join(ones, ["kind", "p1"]).select("kind", "p2", "image_id").join(sketches, "image_id"), "left")
    right, _ = work.write(others.join(near.select("kind", "p2").distinct(), ["kind", "p2"]).join(sketches, "image_id"), "right")
    count = lambda df, n: df.groupBy("kind", "p2").agg(F.count(F.lit(1)).alias(n))
    parts = count(left, "n1").join(count(right, "n2"), ["kind", "p2"]).select("kind", "p2", F.ceil(F.col("n1") * F.col("n2") / MOST_MET).cast("int").alias("parts")).where("parts > 1")
    parts, _ = work.write(parts, "parts")
    of = F.coalesce("parts", F.lit(1))
    x = left.join(F.broadcast(parts), ["kind", "p2"], "left").withColumn("part", F.pmod(F.xxhash64("image_id"), of).cast("int")).alias("x")
    y = right.join(F.broadcast(parts), ["kind", "p2"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), of - 1))).alias("y")
    met = x.join(y, (F.col("x.kind") == F.col("y.kind")) & (F.col("x.p2") == F.col("y.p2")) & (F.col("x.part") == F.col("y.part")) & _may_be_same())
    return met.groupBy(F.col("x.image_id").alias("a"), F.col("y.image_id").alias("b")).agg(F.max(F.col("x.kind") == "i").alias("image"))


def overlaps(lines: DataFrame, manifest: DataFrame, work: Workspace | None = None) -> DataFrame:
    """(train_id, other_id): photographs of the same sale's receipt in train and in val, test or test_seen.

    Of photographs that have no text, or one of which has none, the images decide. Null splits and other splits are left out.
    """
    work = work or Workspace(lines.sparkSession, "overlap")
    photos = photographs(lines, manifest, work)
    pairs = candidates(photos, work)
    texts = photos.select("image_id", "text")
    both = pairs.join(texts.select(F.col("image_id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("image_id").alias("b"), F.col("text").alias("y")), "b")
    silent = (F.col("x") == "|") | (F.col("y") == "|")

    @F.pandas_udf("boolean")
    def same(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        verifier = Verifier()
        for x, y in batches:
            yield pd.Series([verifier.same(s, t) for s, t in zip(x, y)], dtype=bool)

    kept = both.where(silent & F.col("image")).union(both.where(~silent).where(same("x", "y")))
    return kept.select(F.col("a").alias("train_id"), F.col("b").alias("other_id"))
