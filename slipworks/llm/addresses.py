"""Postal addresses that denote the same place though written differently.

A gazetteer is built from the addresses themselves. Names that stand alone between separators and markers are counted, words
that are misspellings of far more frequent ones are told by a join, names are clustered around the right spelling within their
locality, and every street gets an identifier in its city. Each address is then resolved: by its only exact reading if all
its words are names of the gazetteer, else by a beam search over its words, in which hypotheses that assign runs of words to
number, street, ward, district and city are extended from the left and scored by how well they fit the entries. Addresses
with one street identifier, house number and unit are the same place.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.llm.lookalike import shape_of
from slipworks.llm.names import ratio
from slipworks.session import Workspace, to_tasks
from slipworks.sources.tables import spread

#: Entries of a gazetteer that a task holds; a larger one is refused.
MOST_ENTRIES = 1_000_000
#: Hypotheses kept at each place, the least ratio of a name with its entry, and the words that a name may have.
BEAM, NAME_RATIO, MOST_WORDS = 8, 0.7, 4
#: A word may be a misspelling of those that are an edit away and ``TIMES`` as frequent, if these are so frequent that typing
#: errors alone, at most one in ``ERRORS`` for any one wrong form, explain how often it was seen.
TIMES, ERRORS = 8, 20

# Markers before a name, by field, and markers behind one, folded; and how the markers are written with accents.
BEFORE = {
    ("thanh", "pho"): "city", ("tp",): "city", ("quan",): "district", ("q",): "district", ("huyen",): "district", ("h",): "district",
    ("thi", "xa"): "district", ("tx",): "district", ("phuong",): "ward", ("p",): "ward", ("ph",): "ward", ("ward",): "ward",
    ("duong",): "street", ("d",): "street", ("dg",): "street",
}
BEHIND = {"street": "street", "str": "street", "st": "street", "dist": "district", "district": "district", "city": "city"}
ACCENTED = "thành phố quận huyện thị xã phường đường đ đg số nhà hẻm ngõ".split()
HOUSE, ALLEY = ("so", "sn", "nha", "hem", "ngo"), ("hem", "ngo")
WARDS = ("phuong", "p", "ph", "ward")
_LABEL = re.compile(r"^\s*(?:add(?:ress)?|dia chi|d/c|dc)\s*[:.]\s*")
_NOISE = re.compile(r"\(.*?\)|\b(?:dt|sdt|tel|phone)\b[\s:.]*[\d\s.]+|\bviet\s*nam\b|(?<!tp)(?<!tp[ .])\bvn\b")
_TOKEN = re.compile(r"\d+[a-z]?(?:\s?/\s?\d+[a-z]?)*(?![a-z\d])|[a-z]+|[,;]|(?<=\s)-(?=\s)|\d+[a-z]+")


class _Each(dict):
    """For str.translate: each character by a function of it."""

    def __init__(self, make) -> None:
        self.make = make

    def __missing__(self, code: int) -> str:
        self[code] = made = self.make(chr(code))
        return made


_SHAPED = _Each(lambda c: unicodedata.normalize("NFC", shape_of(c)))
_BASE = _Each(lambda c: unicodedata.normalize("NFD", c)[0].replace("đ", "d"))
_MARKS = re.compile(r"[\u0300-\u036f]")


def _fold(word: str) -> str:
    return word.translate(_BASE)


#: Words that may be markers, with the writings that have accents.
_MARKER_WORDS = {w: {a for a in ACCENTED if _fold(a) == w} for w in {w for k in BEFORE for w in k} | set(HOUSE)}


def tokens(address: str) -> list[str]:
    """Folded words, numbers and separators. A word with accents that aren't those of the marker it folds to is a name: it is
    followed by an underscore, so that Phượng isn't taken for a ward."""
    text = _MARKS.sub("", unicodedata.normalize("NFC", address.translate(_SHAPED)).lower())
    plain = text.translate(_BASE)
    blank = lambda m: " " * len(m[0])
    plain = re.sub(r"\bt\.\s?p\b", lambda m: "tp" + " " * (len(m[0]) - 2), plain)
    plain = _NOISE.sub(blank, _LABEL.sub(blank, plain))
    out = []
    for m in _TOKEN.finditer(plain):
        word = m[0]
        if word in _MARKER_WORDS:
            written = text[m.start() : m.end()]
            out.append(word if written.isascii() or written in _MARKER_WORDS[word] else word + "_")
        else:
            out.append(re.sub(r"\s", "", word) if word[0].isdigit() else word)
    return out


def _marker(words: list[str], at: int) -> tuple[str, int]:
    for n in (2, 1):
        field = BEFORE.get(tuple(words[at : at + n]))
        if field and at + n < len(words):
            return field, n
    return "", 0


def _is_number(word: str) -> bool:
    return word[0].isdigit()


def _plain(words: list[str]) -> str:
    return " ".join([w.rstrip("_") for w in words])


def plain_parts(address: str) -> dict[str, str]:
    """Names of up to ``MOST_WORDS`` words that stand alone between separators, numbers and markers; for the gazetteer only."""
    out: dict[str, str] = {}
    chunks: list[list[str]] = [[]]
    for t in tokens(address):
        if t in ",;-":
            chunks.append([])
        else:
            chunks[-1].append(t)
    for words in chunks:
        at = 0
        while at < len(words):
            if _starts_house(words, at) or words[at] in BEHIND:
                at += 1
                continue
            field, n = _marker(words, at)
            start, behind = at + n, at > 0 and _is_number(words[at - 1])
            end = start + 1
            while end < len(words) and not _starts_house(words, end) and words[end] not in BEHIND and not (_marker(words, end)[0] and (end > start + 1 or end + 1 < len(words) and not _marker(words, end + 1)[0])):
                end += 1
            if not field and end < len(words) and words[end] in BEHIND:
                field, after = BEHIND[words[end]], end + 1
            else:
                field, after = field or ("street" if behind and (at < 2 or words[at - 2] not in WARDS) else ""), end
            name = words[start:end]
            if field and 0 < len(name) <= MOST_WORDS and all(len(w) > 1 and not _is_number(w) for w in name) and (len(name) > 1 or len(name[0]) > 2) and field not in out:
                out[field] = _plain(name)
            at = max(after, at + 1)
    return out


class Names:
    """Names of one kind with how often each was seen, found again by what is like them."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.counts = counts
        self.blocks: dict[str, list[str]] = defaultdict(list)
        for name in sorted(counts):
            for k in self._keys(name):
                self.blocks[k].append(name)
        self.near: dict[str, list[tuple[float, str]]] = {}

    def __contains__(self, name: str) -> bool:
        return name in self.counts

    @staticmethod
    def _keys(name: str) -> set[str]:
        words = name.split()
        return {f"{i}{w}" for i, w in enumerate(words)} | {"^" + "".join([w[0] for w in words])} | {"$" + "".join([w[-1] for w in words])}

    def like(self, name: str) -> list[tuple[float, str]]:
        """An exact name alone, else all similar ones, the best first, of equals the more frequent."""
        if name in self.counts:
            return [(1.0, name)]
        if name not in self.near:
            if len(self.near) > 100_000:
                self.near.clear()
            flat = name.replace(" ", "")
            found = {n: ratio(flat, n.replace(" ", "")) for k in self._keys(name) for n in self.blocks.get(k, ())}
            self.near[name] = sorted(((r, n) for n, r in found.items() if r >= NAME_RATIO), key=lambda x: (-x[0], -self.counts[x[1]], x[1]))
        return self.near[name]


class Choice(NamedTuple):
    """A place that an address may denote; ``sure`` if it is the only one with a street of the gazetteer as it is written."""

    city: str
    street: str
    number: str
    unit: str
    fit: float
    sure: bool


class Reading(NamedTuple):
    score: float = 0.0
    number: str = ""
    unit: str = ""
    street: str = ""
    ward: str = ""
    district: str = ""
    city: str = ""


class Gazetteer:
    """Cities, districts with their cities, and streets and wards of each city, with how often each was seen."""

    def __init__(self, cities: dict[str, int], districts: dict[tuple[str, str], int], streets: dict[tuple[str, str], int], wards: dict[tuple[str, str], int]) -> None:
        """``districts``, ``streets`` and ``wards`` count (name, city)."""
        self.cities = Names(cities)
        self.initials: dict[str, list[str]] = defaultdict(list)
        for city in sorted(cities):
            self.initials["".join(w[0] for w in city.split())].append(city)
        self.city_of = {d: c for (d, c), _ in sorted(districts.items(), key=lambda x: (x[1], x[0]))}
        by_city: dict[str, dict[str, int]] = defaultdict(dict)
        for (s, c), n in streets.items():
            by_city[c][s] = n
        self.streets = {c: Names(v) for c, v in by_city.items()}
        self.all = {k: Names(_totals(v)) for k, v in (("district", districts), ("street", streets), ("ward", wards))} | {"city": self.cities}
        self.of_street, self.of_ward = _places(streets), _places(wards)
        #: The usual number of words of each kind of names; others fit a little less where a name is unknown.
        self.usual = {k: Counter({w: sum(n for name, n in v.counts.items() if len(name.split()) == w) for w in (2, 1, 3, 4)}).most_common(1)[0][0] for k, v in self.all.items()}
        self.longest = {k: max((len(name.split()) for name in v.counts), default=1) for k, v in self.all.items()}
        self.fits: dict[tuple[str, str], float] = {}

    def like(self, kind: str, name: str) -> list[tuple[float, str]]:
        return self.all[kind].like(name)

    def fit(self, kind: str, name: str, words: int) -> float:
        """What assigning a run of words to a kind of name adds to a hypothesis."""
        key = (kind, name)
        if key not in self.fits:
            if len(self.fits) > 200_000:
                self.fits.clear()
            found = self.like(kind, name)
            self.fits[key] = (found[0][0] * 2 - 0.9 if found else 0.0) - (0.0 if found and found[0][0] == 1.0 else 0.3 * abs(words - self.usual[kind]))
        return self.fits[key]

    def resolve(self, address: str) -> list[Choice]:
        """The places that an address may denote, the best first: one if it is sure, else all similar streets of every possible
        city, however many. Empty without a house number, a street, or anything that tells the city."""
        words = tokens(address)
        exact = read_exactly(words, self)
        best: tuple[float, list[Choice]] = (-9e9, [])
        for h in [exact] if exact else read(words, self):
            score, places = self._places_of(h)
            if places and score > best[0] + 1e-9:
                best = (score, places)
        return best[1]

    def _cities_of(self, h: Reading) -> dict[str, float]:
        sure: dict[str, float] = {}
        for r, d in self.like("district", h.district) if h.district else ():
            sure[self.city_of[d]] = max(sure.get(self.city_of[d], 0), r)
        whole = h.city in self.cities or " " in h.city
        named = ({c: r for r, c in self.cities.like(h.city)} if whole else {c: 0.9 for c in self.initials.get(h.city, ())}) if h.city else {}
        both = {c: named[c] + sure[c] for c in named if c in sure}
        if both or named and whole or sure:
            return both or (named if whole and named else sure)
        options = dict(named)
        if h.ward and not h.ward.isdigit():
            at = {c for _, w in self.like("ward", h.ward) for c in self.of_ward[w]}
            seen = {c for _, s in self.like("street", h.street) for c in self.of_street[s]} & at
            options = {c: 0.8 for c in seen if not options or c in options} or options
        return options

    def _places_of(self, h: Reading) -> tuple[float, list[Choice]]:
        if not h.number or not h.street:
            return 0.0, []
        choices = []
        for c, r in self._cities_of(h).items():
            streets = self.streets.get(c)
            near = streets.like(h.street) if streets else []
            choices += [(r + fit, c, s) for fit, s in near] or [(r, c, h.street)]
        choices.sort(key=lambda x: (-x[0], x[1:]))
        known = [x for x in choices if x[2] == h.street and x[2] in self.streets.get(x[1], ())]
        top = [x for x in known if x[0] >= choices[0][0] - 1e-9]
        kept, sure = (top, len(top) == 1) if top else (choices, False)
        return (choices[0][0] + h.score if choices else 0.0), [Choice(c, s, h.number, h.unit, fit, sure) for fit, c, s in kept]


def _totals(counts: dict[tuple[str, str], int]) -> dict[str, int]:
    out: dict[str, int] = defaultdict(int)
    for (name, _), n in counts.items():
        out[name] += n
    return dict(out)


def _places(counts: dict[tuple[str, str], int]) -> dict[str, set[str]]:
    out: dict[str, set[str]] = defaultdict(set)
    for name, city in counts:
        out[name].add(city)
    return out


def _house(words: list[str], at: int) -> tuple[int, str, str] | None:
    """(words of it, number, unit) of the house number that starts here, None if there is none or it can't be told."""
    run, i = [], at
    while i < len(words) and (_is_number(words[i]) or words[i] in HOUSE and i + 1 < len(words) and _is_number(words[i + 1]) or run and words[i] == "," and i + 2 < len(words) and words[i + 1] in ALLEY and _is_number(words[i + 2])):
        run.append(words[i])
        i += 1
    numbers = [x for x in run if _is_number(x)]
    if len(numbers) == 2 and any(x in ALLEY for x in run):
        head, *rest = numbers[1].split("/")
        return i - at, head, "/".join([*rest, numbers[0]])
    if len(numbers) == 1:
        head, _, unit = numbers[0].partition("/")
        return i - at, head, unit
    return None


def _starts_house(words: list[str], at: int) -> bool:
    return _is_number(words[at]) or words[at] in HOUSE and at + 1 < len(words) and _is_number(words[at + 1])


def _run(words: list[str], at: int, n: int) -> str | None:
    """The name of the next ``n`` words, if they are words."""
    part = words[at : at + n]
    return _plain(part) if len(part) == n and not any(w in ",;-" or w[0].isdigit() for w in part) else None


def read_exactly(words: list[str], gazetteer: Gazetteer) -> Reading | None:
    """The reading in which every word belongs to a number, a marker or an entry of the gazetteer as it is written; None if there
    is none, or no number or street. No other reading fits better, so the beam search would come to it."""
    got: dict[str, str] = {}
    at, last = 0, ""

    def known(kind: str, start: int) -> tuple[int, str] | None:
        for k in range(gazetteer.longest[kind], 0, -1):
            value = _run(words, start, k)
            if value and value in gazetteer.all[kind]:
                return k, value
        return None

    while at < len(words):
        w = words[at]
        if w in ",;-":
            at, last = at + 1, "sep"
            continue
        if _starts_house(words, at):
            house = _house(words, at)
            if house is None or "number" in got or at and words[at - 1] in WARDS:
                return None
            at, last = at + house[0], "number"
            got |= {"number": house[1], "unit": house[2]}
            continue
        field, n = _marker(words, at)
        if field == "ward" and words[at + n].isdigit():
            step, value = n + 1, words[at + n]
        elif field and (found := known(field, at + n)):
            step, value = n + found[0], found[1]
        elif field == "city" and words[at + n] in gazetteer.initials:
            step, value = n + 1, words[at + n]
        else:
            field = ""
            for kind in ("street", "district", "city"):
                found = known(kind, at)
                after = BEHIND.get(words[at + found[0]]) if found and at + found[0] < len(words) else None
                if found and after == kind:
                    field, step, value = kind, found[0] + 1, found[1]
                    break
                if found and after is None and (kind == "city" or kind == "street" and last == "number"):
                    field, step, value = kind, found[0], found[1]
                    break
        if not field or field in got:
            return None
        got[field] = value
        at, last = at + step, field
    return Reading(score=9.0, **got) if "number" in got and "street" in got else None


def read(words: list[str], gazetteer: Gazetteer) -> list[Reading]:
    """The best readings of an address, at most ``BEAM``."""
    beams: list[list[tuple[Reading, str]]] = [[] for _ in range(len(words) + 1)]
    beams[0] = [(Reading(), "")]
    for at in range(len(words)):
        seen: set[tuple] = set()
        kept = []
        for h, last in sorted(beams[at], key=lambda x: (-x[0].score, x[0][1:], x[1])):
            if (h[1:], last) not in seen:
                seen.add((h[1:], last))
                kept.append((h, last))
                if len(kept) == BEAM:
                    break
        w = words[at]
        starts, (field, n) = w not in ",;-" and _starts_house(words, at), _marker(words, at)
        runs = [] if starts else [(k, value) for k in range(1, MOST_WORDS + 1) if (value := _run(words, at, k))]
        for h, last in kept:

            def go(n: int, gain: float, last_: str, h: Reading = h, **what: str) -> None:
                beams[at + n].append((h._replace(score=h.score + gain, **what), last_))

            if w in ",;-":
                go(1, 0.0, "sep")
                continue
            if starts and at and words[at - 1] in WARDS:
                go(1, -1.5, "skip")
                continue
            if starts:
                house = _house(words, at)
                if house and not h.number:
                    go(house[0], 1.0, "number", number=house[1], unit=house[2])
                go(1, -0.5, "skip")
                continue
            if field == "ward" and words[at + n].isdigit():
                if not h.ward:
                    go(n + 1, 0.8, "ward", ward=words[at + n])
            elif field and not getattr(h, field):
                for k in range(1, MOST_WORDS + 1):
                    value = _run(words, at + n, k)
                    if field == "city" and k == 1 and value in gazetteer.initials:
                        go(n + 1, 0.8, "city", city=value)
                    elif value and (k > 1 or len(value) > 4):
                        go(n + k, 0.4 + gazetteer.fit(field, value, k), field, **{field: value})
            for k, value in runs:
                behind = BEHIND.get(words[at + k]) if at + k < len(words) else None
                if behind and (k > 1 or len(value) > 4) and not getattr(h, behind):
                    go(k + 1, 0.4 + gazetteer.fit(behind, value, k), behind, **{behind: value})
                if (k > 1 or value in gazetteer.all["street"]) and not h.street and last == "number" and not any((x,) in BEFORE and x != "phuong" for x in words[at : at + k]):
                    go(k, 0.2 + gazetteer.fit("street", value, k), "street", street=value)
                if (k > 1 or value in gazetteer.cities) and not h.city:
                    gain = gazetteer.fit("city", value, k)
                    if gain > 0.4:
                        go(k, gain - 0.2, "city", city=value)
            go(1, -0.6, "skip")
    best: dict[tuple, float] = {}
    for h, _ in beams[-1]:
        best[h[1:]] = max(best.get(h[1:], -9e9), h.score)
    return [Reading(s, *k) for k, s in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:BEAM]]


#: Letters of a word that is compared with others for misspellings; longer runs of letters are compared as they are.
_LONGEST_WORD = 32


def misspellings(words: DataFrame) -> DataFrame:
    """(kind, i, word, meant): words that may be a misspelling, with all more frequent words at the same place i of names of the
    same kind that are an edit away, from (kind, i, word, n).

    Two words that are a letter replaced, added, left out or swapped apart become equal when each loses a letter, or one of them
    does, so they meet in a join on what is left of them.
    """
    lost = F.transform(F.sequence(F.lit(1), F.length("word")), lambda k: F.concat(F.substring(F.col("word"), F.lit(1), k - 1), F.substring(F.col("word"), k + 1, F.length("word"))))
    keyed = words.where(F.length("word").between(2, _LONGEST_WORD)).select("kind", "i", "word", "n", F.explode(F.array_distinct(F.concat(F.array("word"), lost))).alias("key"))
    other = keyed.select("kind", "i", "key", F.col("word").alias("right"), F.col("n").alias("m"))
    pairs = keyed.join(other, ["kind", "i", "key"]).where((F.col("m") >= TIMES * F.col("n")) & (F.col("word") != F.col("right"))).select("kind", "i", "word", "n", "right", "m").distinct()
    return pairs.groupBy("kind", "i", "word", "n").agg(F.collect_set("right").alias("meant"), F.sum("m").alias("m")).where(F.col("n") <= 2 + F.col("m") / ERRORS).select("kind", "i", "word", "meant")


def clustered(names: DataFrame, wrong: DataFrame) -> DataFrame:
    """(kind, place, name, entry, n): each name with the entry of its place whose spelling it is, itself if it is an entry.

    ``names`` has kind, place, name and n; ``place`` is a locality or ''. A name with misspelled words is a spelling of the most
    frequent name of its place that has them put right, else of the only one that there could be. A longer name that begins
    with a far more frequent one ran together with what follows and is a spelling of that. A name of several words none of
    which is right, and no entry for it, has a null entry.
    """
    key = ["kind", "place", "name"]
    words = names.select(*key, "n", F.split("name", " ").alias("words"))
    each = words.select(*key, "words", F.posexplode("words").alias("i", "word")).join(wrong, ["kind", "i", "word"])
    choices = each.groupBy(*key).agg(F.first("words").alias("words"), F.map_from_entries(F.collect_list(F.struct("i", "meant"))).alias("fix"))
    grown = F.aggregate(F.transform("words", lambda w, k: F.coalesce(F.concat(F.array(w), F.col("fix")[k]), F.array(w))), F.array(F.lit("")), lambda done, ws: F.flatten(F.transform(done, lambda d: F.transform(ws, lambda w: F.ltrim(F.concat_ws(" ", d, w))))))
    fixed = choices.select(*key, (F.size("fix") == F.size("words")).alias("all_wrong"), F.size("words").alias("size"), F.explode(F.array_except(grown, F.array("name"))).alias("meant"))
    there = names.select("kind", "place", F.col("name").alias("meant"), F.col("n").alias("m"))
    best = fixed.join(there, ["kind", "place", "meant"], "left").groupBy(*key).agg(F.max_by("meant", F.struct("m", "meant")).alias("best"), F.max("m").alias("m"), F.count(F.lit(1)).alias("ways"), F.first("meant").alias("only"), F.first(F.col("all_wrong") & (F.col("size") > 1)).alias("none_right"))
    starts = F.array(*[F.array_join(F.slice("words", 1, k), " ") for k in range(1, MOST_WORDS)])
    heads = words.select(*key, "n", F.explode(F.array_except(starts, F.array("name"))).alias("head")).where("head <> ''")
    run = heads.join(names.select("kind", "place", F.col("name").alias("head"), F.col("n").alias("m")), ["kind", "place", "head"]).where(F.col("m") >= TIMES * F.col("n")).groupBy(*key).agg(F.max_by("head", F.struct("m", "head")).alias("head"))
    out = names.join(best, key, "left").join(run, key, "left")
    entry = F.when(F.col("head").isNotNull(), F.col("head")).when(F.col("ways").isNull(), F.col("name")).when(F.col("m") >= F.col("n"), F.col("best")).when(F.col("ways") == 1, F.col("only")).when(~F.col("none_right"), F.col("name"))
    return out.select(*key, entry.alias("entry"), "n")


def _collected(df: DataFrame) -> list:
    rows = df.limit(MOST_ENTRIES + 1).collect()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"a gazetteer of more than {MOST_ENTRIES} entries")
    return rows


def street_id(city: Column, street: Column) -> Column:
    return F.xxhash64(city, F.lit("/"), street)


def build_gazetteer(addresses: DataFrame, column: str, work: Workspace) -> tuple[Gazetteer, DataFrame]:
    """The gazetteer of distinct addresses, and its streets (city, street, n, street_id).

    Names are counted, told from misspellings and clustered in their locality by joins; only entries, whose number is that of a
    country's names and is checked, come to the driver.
    """

    @F.pandas_udf("street string, ward string, district string, city string")
    def parts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([plain_parts(a) for a in batch], columns=["street", "ward", "district", "city"], dtype=object)

    found, _ = work.write(spread(addresses).select(parts(F.col(column)).alias("p")).select("p.*").groupBy("street", "ward", "district", "city").agg(F.count(F.lit(1)).alias("n")), "parts")
    fields = ("street", "ward", "district", "city")
    named = found.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in fields])).alias("x")).select("n", "x.*").where("name is not null")
    words = named.select("kind", "n", F.posexplode(F.split("name", " ")).alias("i", "word")).groupBy("kind", "i", "word").agg(F.sum("n").alias("n"))
    wrong, _ = work.write(misspellings(words), "wrong")
    country = named.where("kind in ('city', 'district')").groupBy("kind", F.lit("").alias("place"), "name").agg(F.sum("n").alias("n"))
    country, _ = work.write(clustered(country, wrong).where("entry is not null"), "country")
    counted = _collected(country.groupBy("kind", "entry").agg(F.sum("n").alias("n")))
    cities = {r["entry"]: r["n"] for r in counted if r["kind"] == "city"}
    of = {k: country.where(F.col("kind") == k).select(F.col("name").alias(k), F.col("entry").alias(f"{k}_entry")) for k in ("city", "district")}
    entered = found.join(of["city"], "city", "left").join(of["district"], "district", "left")
    entered, _ = work.write(entered.select("street", "ward", F.col("city_entry").alias("city"), F.col("district_entry").alias("district"), "n"), "entered")
    districts = {(r["district"], r["city"]): r["n"] for r in _collected(entered.where("city is not null and district is not null").groupBy("district", "city").agg(F.sum("n").alias("n")))}
    city_of = addresses.sparkSession.createDataFrame(sorted({d: c for (d, c), _ in sorted(districts.items(), key=lambda x: (x[1], x[0]))}.items()), "district string, its_city string")
    placed = entered.join(city_of, "district", "left").select("street", "ward", F.coalesce("city", "its_city").alias("place"), "n").where("place is not null")
    local = placed.select("place", "n", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).alias("name")) for c in ("street", "ward")])).alias("x")).select("place", "n", "x.*").where("name is not null").groupBy("kind", "place", "name").agg(F.sum("n").alias("n"))
    local, _ = work.write(local, "local")
    entries, _ = work.write(clustered(local, wrong).where("entry is not null").groupBy("kind", F.col("place").alias("city"), F.col("entry").alias("name")).agg(F.sum("n").alias("n")), "entries")
    streets = entries.where("kind = 'street'").select("city", F.col("name").alias("street"), "n", street_id(F.col("city"), F.col("name")).alias("street_id"))
    by_kind: dict[str, dict[tuple[str, str], int]] = {"street": {}, "ward": {}}
    for r in _collected(entries):
        by_kind[r["kind"]][r["name"], r["city"]] = r["n"]
    return Gazetteer(cities, districts, by_kind["street"], by_kind["ward"]), streets


def places(addresses: DataFrame, column: str = "address", work: Workspace | None = None) -> DataFrame:
    """(address, city, street, number, unit, street_id) of each distinct address that denotes one place.

    A street that is written as its city's gazetteer has it is that street, whatever other addresses say. One that isn't, or a
    street of several possible cities, is the possible one that most sure addresses state with its number and unit, of equals
    the one that fits best. No row for null, blank and vague addresses and for those without a house number.
    """
    work = work or Workspace(addresses.sparkSession, "places")
    distinct, _ = work.write(addresses.where(F.col(column).isNotNull()).select(F.col(column).alias("address")).distinct(), "addresses")
    gazetteer, streets = build_gazetteer(distinct, "address", work)
    shared = to_tasks(addresses.sparkSession, gazetteer)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(a, i, *p) for a in batch["address"] for i, p in enumerate(shared.value.resolve(a))]
            yield pd.DataFrame(rows, columns=["address", "choice", "city", "street", "number", "unit", "fit", "sure"])

    choices = spread(distinct).mapInPandas(run, "address string, choice int, city string, street string, number string, unit string, fit double, sure boolean")
    choices, _ = work.write(choices, "choices")
    place = ["city", "street", "number", "unit"]
    stated = choices.where("sure").groupBy(*place).agg(F.count(F.lit(1)).alias("stated"))
    open_ = choices.where("not sure").join(stated, place, "left")
    rank = F.struct(F.coalesce("stated", F.lit(0)), "fit", (-F.col("choice")).alias("c"))
    settled = open_.groupBy("address").agg(F.max_by(F.struct(*place), rank).alias("p")).select("address", "p.*").union(choices.where("sure").select("address", *place))
    ids = streets.select(F.col("city").alias("c"), F.col("street").alias("s"), "street_id")
    named = settled.join(ids, (F.col("city") == F.col("c")) & (F.col("street") == F.col("s")), "left")
    return named.select("address", *place, F.coalesce("street_id", street_id(F.col("city"), F.col("street"))).alias("street_id"))


def same_place_pairs(receipts: DataFrame, key: str, address: str) -> DataFrame:
    """(a, b): keys of rows whose addresses denote the same place and aren't the same text, the smaller key first.

    Rows of one place and one text are compared as a group, so copies of a text don't multiply before the last join.
    """
    rows = receipts.where(F.col(key).isNotNull() & F.col(address).isNotNull()).select(F.col(key).alias("key"), F.col(address).alias("address")).distinct()
    work = Workspace(receipts.sparkSession, "places")
    of, _ = work.write(places(rows, "address", work), "settled")
    place = ["street_id", "number", "unit"]
    left, right = of.select(*place, F.col("address").alias("x")), of.select(*place, F.col("address").alias("y"))
    texts = left.join(right, place).where("x < y").select("x", "y")
    ones, others = rows.select(F.col("key").alias("k1"), F.col("address").alias("x")), rows.select(F.col("key").alias("k2"), F.col("address").alias("y"))
    return texts.join(ones, "x").join(others, "y").where("k1 <> k2").select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).distinct()
