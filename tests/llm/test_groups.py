"""Groups of photographs against the plain double loop."""

import difflib
import random
import re
import unicodedata

from slipworks.llm.groups import receipt_groups
from slipworks.operators.corpus import fuzzy_pairs

SCHEMA = "image_id string, image_hash bigint, gt struct<merchant_name string, merchant_address string, transaction_date string, transaction_time string, total bigint>"


def test_fuzzy_pairs_of_repetitive_and_short_strings(spark):
    random.seed(4)
    keys = ["abababababababab", "ababababababab", "aaaaaaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaaaaa", "abcd", "abxcd", "xin chao", *("".join(random.choices("ab ", k=random.randrange(1, 30))).strip() or "b" for _ in range(120))]
    real = sorted(set(keys))
    got = {(r.a, r.b, r.ratio) for r in fuzzy_pairs(spark.createDataFrame([(k,) for k in keys], "s string"), "s", 0.86).collect()}
    ratios = {(a, b): difflib.SequenceMatcher(None, a, b).ratio() for i, a in enumerate(real) for b in real[i + 1 :]}
    assert got == {(a, b, r) for (a, b), r in ratios.items() if r >= 0.86}
    assert ("abcd", "abxcd", 8 / 9) in got


def _key(s, least):
    k = re.sub(r"[^\w ]", "", re.sub(r"\s+", " ", unicodedata.normalize("NFC", s or "")).strip().lower()).strip()
    return k if k and len(k) >= least and "tên đại lý" not in k else None


def _plain(rows):
    """Groups as sets, and dup_of, by comparing every record with all earlier ones."""
    n, group, dup = len(rows), list(range(len(rows))), {}

    def join(i, j):
        old, new = group[i], group[j]
        group[:] = [new if g == old else g for g in group]

    for i in range(n):
        for j in range(i):
            if None not in (rows[i][1], rows[j][1]) and bin((rows[i][1] ^ rows[j][1]) & (2**64 - 1)).count("1") <= 3:
                join(i, j)
                dup.setdefault(i, rows[j][0])
    seen = {}
    for i, (_, _, (name, _, day, clock, total)) in enumerate(rows):
        if day and clock and total:
            j = seen.setdefault((day, clock, total, _key(name, 1)), i)
            if i != j:
                join(i, j)
                dup.setdefault(i, rows[j][0])
    for field, least, threshold in ((0, 6, 0.86), (1, 12, 0.9)):
        keys = [_key(r[2][field], least) for r in rows]
        for i in range(n):
            for j in range(i):
                if keys[i] and keys[j] and difflib.SequenceMatcher(None, keys[i], keys[j]).ratio() >= threshold:
                    join(i, j)
    return group, dup


def test_groups_equal_the_double_loop(spark):
    random.seed(9)
    names = ["Trà sữa Thêu Nắng", "Trà sữa Thêu Nắngg", "Bách hoá Sông Xanh", "Bách hoá Sông  XANH!", "Tên đại lý", "Quán", "Cửa hàng Mây Ngàn", "", None]
    places = ["168 Đường Rừng Nghệ Tây Vịnh", "168 Đường Rừng Nghệ, Tây Vịnhh", "12 phố Mây Trắng quận Bình Khê", "ngõ 4", None]
    rows = []
    for k in range(70):
        name, place = (random.choice(names), random.choice(places)) if random.random() < 0.2 else (f"{random.getrandbits(60):x}", None)
        h = random.getrandbits(63) if k % 5 or not rows else (rows[-1][1] or 0) ^ (1 << random.randrange(64) if random.random() < 0.5 else 0)
        h = h - (1 << 64) if h >> 63 == 1 else h
        rows.append((f"p{k:03d}", None if k % 17 == 3 else h, (name, place, random.choice(["2020-01-02", None]), random.choice(["10:00:00", "11:00:00"]), random.choice([0, 500, None, 700]))))
    got = {r.image_id: r for r in receipt_groups(spark.createDataFrame([*rows, rows[0]], SCHEMA)).collect()}
    group, dup = _plain(rows)
    least = {}
    for g, r in zip(group, rows):
        least.setdefault(g, r[0])
    assert len(got) == len(rows) and 1 < len(least) < len(rows) and dup
    for i, (g, r) in enumerate(zip(group, rows)):
        assert (got[r[0]].group_id, got[r[0]].group_size, got[r[0]].dup_of) == (least[g], group.count(g), dup.get(i))
