"""Fields of a receipt from its lines in reading order: candidates are scored and the best of each page is kept.

What can be told from a line alone (amounts, date, time, words for totals) are built-in column expressions over all lines. What
depends on other lines of the page is decided page by page in Arrow batches, each page a run of rows that needs no shuffle after
``spatial.reading_order``. Every choice has a total order.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from statistics import median
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.functions.text import fold, has_keyword, keyword_pattern, plain_fold
from slipworks.functions.values import parse_date, parse_time, parse_vnd

# Folded words that mark fields, and bounds of amounts.
LEAST_AMOUNT, MOST_AMOUNT = 1_000, 100_000_000
TOTAL_STRONG = ["tong cong", "tong so tien thanh toan", "tong tien thanh toan", "tong thanh toan", "tien thanh toan", "khach phai tra", "phai thanh toan", "tong tien phai tra", "phai t.toan", "phai tra"]
TOTAL_MID = ["thanh toan", "total", "thanh tien"]
TOTAL_WEAK = ["tong tien", "tong", "cong tien hang"]
TOTAL_NEVER = ["khach dua", "khach tra", "tien thua", "tra lai", "chiet khau", "khuyen mai", "so luong", "tong sl", "diem", "tem", "phuong thuc", "hinh thuc", "tong ket", "phieu thanh toan", "da thanh toan"]
TOTAL_SELDOM = ["vat", "thue", "tien mat"]
DISCOUNT = r"\bgiam(?:\s+gia\b|\s*[:=]|\s+\d)|\b(?:da|a)\s+giam\b"
CONTACT = r"\b(?:tel|dt|sdt|hotline|mst|fax|email|website|www|http)\b|ma so thue|dien thoai"
DATE_WORDS, TIME_NEVER = ["ngay", "date", "thoi gian"], ["lam viec", "mo cua", "hang ngay", "hotline"]
SELLER_BRAND = ["sieu thi", "cua hang", "cty", "cong ty", "tnhh", "mart", "store", "shop", "coop", "co.op", "bach hoa", "cafe", "nha hang", "tap hoa", "minimart", "nha thuoc", "trung tam", "pharmacy", "highlands", "phuc long", "vincommerce", "vinmart", "winmart", "coffee"]
SELLER_NEVER = ["tel", "dt:", "dien thoai", "hotline", "dia chi", "dc:", "mst", "ma so thue", "www", "http", "email", "fax", "hoa don", "hoa on", "ban hang", "phieu", "tinh tien", "so hd", "ngay", "khach hang", "thu ngan", "tra lai", "tien tra", "cam on", "tong cong", "thanh tien", "so luong", "ward", "district", "street"]
SELLER_TIME = r"\bgio\s*(?:[:=]|\d)|\bgio\s+(?:lam viec|mo cua)\b"
SELLER_KIND = r"(?:coffee|coffees|cafe|tea|tiem tra|nha hang|cua hang|sieu thi|cong ty(?:\s+tnhh)?)(?:\s*(?:&|and|va)\s*(?:coffee|tea|cafe))?"
ADDRESS_WORDS = ["dia chi", "duong", "phuong", "quan", "huyen", "tinh", "thanh pho", "ha noi", "ho chi minh", "tphcm", "tp", "xa", "thon", "khu", "ngo", "hem", "pho", "cho"]
ADDRESS_SHORT = r"\b(?:tp|p|q|kp)\.\s*(?=\w)|\b(?:p|q)\s*\d+\b|\bso\s+\d+\b"
ADDRESS_NEVER = ["hoa don", "so hd", "so ca", "so luong", "ngay", "tong", "doanh so"]
STREET_NUMBER = r"^\s*\d{1,4}(?:[/\-]\d{1,4}[a-z]?)?\s+[^\W\d_]{2,}\b"
ADDRESS_LABEL, LABEL_ALONE = r"^\s*(?:dia chi|dc|d/c)\s*[:.\-]\s*\S", r"^\s*(?:dia chi|dc|d/c)\s*[:.\-]*\s*$"
ADDRESS_MARK, NAME_END = r"^\s*(?:địa chỉ|dia chi|đc|dc|d/c)(?!\w)\s*[:.\-]?\s*", r"\s+[-–—|]\s+|\b(?:địa chỉ|dia chi|đc|dc)\s*:"

# How amounts are grouped, which of them count without separators, and what may stand before them.
GROUPED = r"\d{1,3}(?:[ \x{A0}]*[.,][ \x{A0}]*\d{3})+(?:[.,]\d{1,2})?|\d{1,3}(?:[ \x{A0}]+\d{3})+(?![ \x{A0}]+\d)"
HUNDREDS, BARE, EDGE = r"[1-9]\d{1,6}00", r"[1-9]\d{3,8}", r"(?![\d.,/\-])"
FIELDS = ("merchant_name", "merchant_address", "date", "time", "total")


def _amounts_pattern(words: list[str]) -> str:
    """Amounts alone, before the currency, or bare ones right behind the currency or one of ``words``, which are part of the match."""
    ahead = "|".join([r"\b(?:vnd|d)", *([keyword_pattern(words).removeprefix("(?U)")] if words else [])])
    return rf"(?U)(?<![\w.,/\-])(?:(?:{GROUPED}){EDGE}|{HUNDREDS}{EDGE}|{BARE}(?=\s*(?:vnd|d)(?!\w)){EDGE})|(?:{ahead})(?:\s{{1,3}}[:=]?\s{{0,3}}|[:=]\s{{0,3}}){BARE}{EDGE}"


def amounts_in(text: Column) -> Column:
    """Amounts of a line as written; see ``amounts_of``."""
    return amounts_of(fold(text))


def amounts_of(key: Column) -> Column:
    """Amounts of a line in order: none on a line with contact words; figures without separators that aren't a multiple of 100
    only right behind a word for the total or beside the currency. Text is folded, in which places are the same."""

    def found(words: list[str]) -> Column:
        return F.filter(F.transform(F.regexp_extract_all(key, F.lit(_amounts_pattern(words)), F.lit(0)), parse_vnd), lambda a: a.between(LEAST_AMOUNT, MOST_AMOUNT))

    none = F.array().cast("array<bigint>")
    totals = [*TOTAL_STRONG, *TOTAL_MID, *TOTAL_WEAK]
    plain = has_keyword(key, TOTAL_NEVER) | ~has_keyword(key, totals)
    return F.when(~key.rlike(r"\d{3}") | key.rlike(CONTACT), none).when(plain, found([])).otherwise(found(totals))


def line_features(lines: DataFrame) -> DataFrame:
    """Lines in reading order with what each tells alone: amounts, day, clock, the weight of its word for a total (0 without
    one), and whether it is never or seldom a total."""
    key, text = F.col("key"), F.col("text")
    digits = key.rlike(r"\d")  # full-width ones too, which folding leaves
    weight = F.when(has_keyword(key, TOTAL_STRONG), 3).when(has_keyword(key, TOTAL_MID), 2).when(has_keyword(key, TOTAL_WEAK), 1).otherwise(0)
    wide = text.rlike(r"(?U)\d")
    return lines.select("*", F.when(digits, amounts_of(key)).otherwise(F.array().cast("array<bigint>")).alias("amounts"), F.when(wide, parse_date(text)).alias("day"), F.when(wide, parse_time(text)).alias("clock"), weight.alias("weight"), (has_keyword(key, TOTAL_NEVER) | key.rlike(DISCOUNT)).alias("never"), has_keyword(key, TOTAL_SELDOM).alias("seldom"))


class Line(NamedTuple):
    idx: int
    row: int
    pos: int
    text: str
    key: str
    score: float
    cx: float
    x0: float
    y0: float
    x1: float
    y1: float
    height: float
    amounts: list[int]
    day: str | None
    clock: str | None
    weight: int
    never: bool
    seldom: bool


class Found(NamedTuple):
    """One field of a page; without a value if the page has none."""

    value: str | None = None
    confidence: float = 0.0
    rule: str = "none"
    evidence: tuple[str, ...] = ()
    features: dict[str, float] = {}


def _words(words: list[str]) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(re.escape(w) for w in words) + r")(?!\w)")


_SELLER_BRAND, _SELLER_NEVER, _ADDRESS_NEVER = _words(SELLER_BRAND), _words(SELLER_NEVER), _words(ADDRESS_NEVER)
_JOINED_BRAND, _SELLER_TIME, _CONTACT = re.compile(r"\b(?:co\.?op\w*|\w+mart)\b"), re.compile(SELLER_TIME), re.compile(CONTACT)
#: What speaks for an address, and how much.
_ADDRESS_SIGNS = [*((_words([w]), 3 if w == "dia chi" else 1) for w in ADDRESS_WORDS), (re.compile(STREET_NUMBER), 2), (re.compile(ADDRESS_LABEL), 2)]
_ADDRESS_SHORT, _LABEL_ALONE, _MARK, _NAME_END = re.compile(ADDRESS_SHORT), re.compile(LABEL_ALONE), re.compile(ADDRESS_MARK, re.I), re.compile(NAME_END, re.I)
_KIND = re.compile(SELLER_KIND)


def total_of(page: list[Line]) -> Found:
    """The amount that a word for the total points at: on its line, else the last amount to its right, else the last of the next
    row at a lower weight; the heaviest, of equals the lowest on the page. Without such a word the largest amount of the page."""
    last: dict[int, Line] = {}
    for line in page:
        if line.amounts:
            last[line.row] = line  # rows are in order of place
    pointed = []
    for line in page:
        if not line.weight or line.never or line.seldom and line.weight < 3:
            continue
        beside, below = last.get(line.row), last.get(line.row + 1)
        if line.amounts:
            pointed.append((line.weight, line, line, "same_line"))
        elif beside and beside.cx > line.cx:
            pointed.append((line.weight, line, beside, "same_row"))
        elif below:
            pointed.append((line.weight - 1, line, below, "next_row"))
    largest = max((a for line in page for a in line.amounts), default=None)
    if pointed:
        times = Counter(of.amounts[-1] for _, _, of, _ in pointed)
        weight, line, of, place = max(pointed, key=lambda p: (p[0] + min(times[p[2].amounts[-1]] - 1, 2) / 2, p[1].row, -p[1].idx))
        amount = of.amounts[-1]
        trust = (0.6, 0.7, 0.85, 0.95)[weight] + (0.05 if times[amount] > 1 else 0.0)
        features = {"ocr_conf": of.score, "agree": times[amount], "key_weight": weight, "is_max": amount == largest, "n_cands": len(pointed), "distinct": len(times)}
        return Found(str(amount), min(1.0, trust) * of.score, f"keyword:{place}", (line.text, of.text), features)
    if largest is None:
        return Found()
    of = next(line for line in page if largest in line.amounts)
    return Found(str(largest), 0.4 * of.score, "fallback:max_amount", (of.text,), {"ocr_conf": of.score, "agree": 0, "key_weight": 0, "is_max": 1, "n_cands": 0, "distinct": 0})


def date_of(page: list[Line], today: str) -> Found:
    """A date from 2000 on up to ``today``; beside a word for dates before others, then the highest on the page. Such words
    count inside others too."""
    dated = [line for line in page if line.day and "2000-01-01" <= line.day <= today]
    if not dated:
        return Found()
    named = {line.idx for line in dated if any(w in line.key for w in DATE_WORDS)}
    line = min(dated, key=lambda d: (d.idx not in named, d.row, d.pos))
    days, beside = Counter(other.day for other in dated), line.idx in named
    return Found(line.day, (0.95 if beside else 0.8) * line.score, "date_regex", (line.text,), {"ocr_conf": line.score, "keyword": beside, "n_distinct": len(days), "agree": days[line.day]})


def time_of(page: list[Line], date_text: str | None) -> Found:
    """A time of day on the line of the date, then in its row, then up to two rows below; of a page without a date, the first.
    The date's line is the first with its text."""
    at = next((line for line in page if date_text and line.text == date_text), None)
    able = [line for line in page if line.clock and not any(w in line.key for w in TIME_NEVER) and (at is None or at.row <= line.row <= at.row + 2)]
    if not able:
        return Found()
    line = min(able, key=lambda t: (t is not at, t.idx))
    there = line is at if at is not None else line.idx == 0
    return Found(line.clock, (0.9 if there else 0.75) * line.score, "time_regex", (line.text,), {"ocr_conf": line.score, "same_line": there})


def address_hits(key: str) -> int:
    """How much a folded line looks like an address: words, short forms, a number before a street, a label."""
    if _CONTACT.search(key) or _LABEL_ALONE.match(key) or _ADDRESS_NEVER.search(key):
        return 0
    short = len(_ADDRESS_SHORT.findall(key))
    signs = [weight for sign, weight in _ADDRESS_SIGNS if sign.search(key)]
    return sum(signs) + short + bool((signs or short) and any(c.isdigit() for c in key))


def _branded(key: str) -> bool:
    return bool(_SELLER_BRAND.search(key) or _JOINED_BRAND.search(key))


def _title(line: Line, top: list[Line], hits: list[int]) -> str:
    """A line without the address behind the name, and without a branch behind a brand if an address nearby repeats it."""
    text = line.text.strip()
    cut = next((m.start() for m in _NAME_END.finditer(text) if address_hits(plain_fold(text[m.end() :])) >= 2), None)
    text = text if cut is None else text[:cut].strip()
    starts = [m.start() for m in re.finditer(r"\S+", text)]
    for at in starts[1:-1]:
        head, branch = plain_fold(text[:at].strip()), plain_fold(text[at:]).strip()
        if _branded(head) and not _KIND.fullmatch(head) and any(h >= 2 and other.idx != line.idx and _words([branch]).search(other.key) for other, h in zip(top, hits)):
            return text[:at].strip()
    return text


def _belong(a: Line, b: Line, one: str, other: str, body: float) -> bool:
    """Whether two lines are parts of one title: near, of like size, and either a kind of shop or both large and in capitals."""
    tall, low = max(a.y1 - a.y0, b.y1 - b.y0, 1), min(max(a.y1 - a.y0, 1), max(b.y1 - b.y0, 1))
    beside = abs((a.y0 + a.y1) - (b.y0 + b.y1)) <= tall
    gap = max(a.x0, b.x0) - min(a.x1, b.x1) if beside else max(a.y0, b.y0) - min(a.y1, b.y1)
    centred = beside or abs((a.x0 + a.x1) - (b.x0 + b.x1)) <= max(a.x1 - a.x0, b.x1 - b.x0)
    alike = low >= 0.6 * tall and centred and gap <= (2 if beside else 1.5) * tall
    return alike and (any(_KIND.fullmatch(plain_fold(t)) for t in (one, other)) or low >= 1.3 * body and one.isupper() and other.isupper())


def _joined(page: list[Line], titles: dict[int, str], at: int, step: int, room: int, body: float) -> int:
    """How many titles from a line on, in one direction, belong to the one before each; a repeated one doesn't."""
    for n in range(room):
        here, there = at + step * n, at + step * (n + 1)
        if there not in titles or plain_fold(titles[there]) == plain_fold(titles[here]) or not _belong(page[here], page[there], titles[here], titles[there], body):
            return n
    return room


def seller_of(page: list[Line], top: list[Line], hits: list[int]) -> tuple[Found, int]:
    """The title among the first 8 lines by words for sellers, capitals, recognition score, place and size, with up to two
    neighbours that belong to it; and where it starts, -1 if there is none."""
    body = median(line.height for line in top) if top else 1.0
    titles: dict[int, str] = {}
    best, points = -1, 0.0
    for line in page[:8]:
        text = _title(line, top, hits)
        key, letters = plain_fold(text), sum(c.isalpha() for c in text)
        if letters < 3 or letters < 0.6 * len(text) or _SELLER_NEVER.search(key) or _SELLER_TIME.search(key) or not _branded(key) and address_hits(key) >= 2:
            continue
        titles[line.idx] = text
        size = min(max(line.height / body - 1, 0.0), 2.0)
        worth = 3 * _branded(key) + (sum(c.isupper() for c in text) / letters > 0.8) + line.score - 0.15 * line.idx + 2 * size
        if worth > points:
            best, points = line.idx, worth
    if best < 0:
        return Found(), -1
    above = _joined(page, titles, best, -1, 2, body)
    first, last = best - above, best + _joined(page, titles, best, 1, 2 - above, body)
    parts = page[first : last + 1]
    name = " ".join(titles[line.idx] for line in parts)
    brand, score = _branded(plain_fold(name)), min(line.score for line in parts)
    return Found(name, (0.9 if brand else 0.65) * score, "top_lines", tuple(line.text for line in parts), {"ocr_conf": score, "brand": brand, "index": first, "n_lines": len(parts)}), first


def address_of(top: list[Line], hits: list[int], seller: int, seller_lines: tuple[str, ...], span: int = 3, near: int = 4) -> Found:
    """The line that looks most like an address, of equals the one nearest to the seller, joined with up to ``span`` - 1 others
    within ``near`` lines, in reading order, without the label. A label alone speaks for the line below it."""
    strength = {line.idx: h for line, h in zip(top, hits) if line.idx != seller and line.text not in seller_lines}
    for label, line in zip(top, top[1:]):
        named = sum(c.isalpha() for c in line.text) >= 3 and not (line.day or line.amounts or _CONTACT.search(line.key) or _SELLER_NEVER.search(line.key))
        if named and line.idx in strength and _LABEL_ALONE.match(label.key):
            strength[line.idx] = max(strength[line.idx], 2)
    below = seller + 1 if seller >= 0 else -1
    able = [line for line in top if strength.get(line.idx, 0) >= (1 if line.idx == below else 2)]
    if not able:
        return Found()
    able.sort(key=lambda line: (-strength[line.idx], abs(line.idx - max(seller, 0)), line.idx))
    head = able[0].idx
    chosen = sorted([line for line in able if abs(line.idx - head) <= near][:span])
    parts = [p for line in chosen if (p := _MARK.sub("", line.text).strip())]
    score = min(line.score for line in chosen)
    if not parts:
        return Found()
    return Found(" ".join(parts), score * (0.9 if strength[head] >= 3 else 0.7), "address_tokens", tuple(line.text for line in chosen), {"ocr_conf": score, "hits": strength[head], "n_lines": len(chosen)})


def fields_of(page: list[Line], today: str, window: int = 12) -> dict[str, Found]:
    """The fields of a page whose lines are in reading order."""
    top = page[:window]
    hits = [address_hits(line.key) for line in top]
    seller, at = seller_of(page, top, hits)
    day = date_of(page, today)
    return {"merchant_name": seller, "merchant_address": address_of(top, hits, at, seller.evidence), "date": day, "time": time_of(page, day.evidence[0] if day.evidence else None), "total": total_of(page)}


_RESULT = pa.struct([("value", pa.string()), ("confidence", pa.float64()), ("rule", pa.string()), ("evidence", pa.list_(pa.string())), ("features", pa.map_(pa.string(), pa.float64()))])


def extract_fields(lines: DataFrame, today: str) -> DataFrame:
    """(image_id, merchant_name, merchant_address, date, time, total, lines, mean_rec_score): one row for each page, each field a
    struct<value, confidence, rule, evidence, features>, without a value where the page has none.

    ``lines`` are those of ``spatial.reading_order``. A page's lines are one array for a moment.
    """
    names = Line._fields
    pages = line_features(lines).groupBy("image_id").agg(F.collect_list(F.struct(*names)).alias("lines"))
    schema = pa.schema([("image_id", pa.string()), *[(f, _RESULT) for f in FIELDS], ("lines", pa.int32()), ("mean_rec_score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch.column(1)
            flat = pages.flatten()
            rows = list(map(Line._make, zip(*[flat.field(n).to_pylist() for n in names])))
            offsets, made, start = pages.offsets.to_pylist(), [], pages.offsets[0].as_py()
            for a, b in zip(offsets, offsets[1:]):
                page = sorted(rows[a - start : b - start])
                found = fields_of(page, today)
                made.append({f: r._asdict() | {"features": [(k, float(v)) for k, v in r.features.items()], "evidence": list(r.evidence)} for f, r in found.items()} | {"lines": b - a, "mean_rec_score": sum(x.score for x in page) / (b - a)})
            columns = [batch.column(0), *[pa.array([m[f.name] for m in made], f.type) for f in list(schema)[1:]]]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    field = "struct<value: string, confidence: double, rule: string, evidence: array<string>, features: map<string, double>>"
    return pages.mapInArrow(run, f"image_id string, {', '.join(f'`{f}` {field}' for f in FIELDS)}, lines int, mean_rec_score double")
