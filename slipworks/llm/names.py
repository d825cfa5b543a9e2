"""Variant spellings of names typed by people, linked to the entity of a register that they mean.

Blocking is by suffixes of tokens: every suffix of at least ``SHORTEST`` letters of a name's own words stands for the entities
that have it. A suffix that stands for too many is not dropped: it is refined by other fields, the trade and the ends of the
name's other words, one after the other until few are left; and if none of those fits, all entities of the common suffixes
are compared after all. Pairs are compared by the ratio of their longest common subsequence, word by word and over the whole.

How trades are abbreviated is learnt from the names themselves: what stands beside the exact own words of entities of one
trade, and of hardly any other, is a writing of that trade.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.llm.lookalike import shape_of
from slipworks.session import to_tasks
from slipworks.sources.tables import spread

SHORTEST = 3
#: Entities that one suffix may stand for before it is refined, and one refined suffix before it is refined further.
COMMON, COMMON_REFINED = 40, 100
#: Least ratio of one word and of the whole name.
WORD_RATIO, NAME_RATIO = 0.4, 0.8
#: A writing of a trade is seen with at least so many of its entities, and with so few others.
ALIAS_ENTITIES, ALIAS_SHARE = 2, 0.9

# Forms of address before a name, and what is printed after one.
TITLES = {"anh": ["anh", "a", "mr"], "ba": ["ba", "ms", "mrs"], "chu": ["chu", "c", "mr"], "co": ["co", "c", "ms"], "di": ["di", "d", "ms"], "ong": ["ong", "o", "mr"]}
RANKS = {"hai": "2", "ba": "3", "tu": "4", "nam": "5", "sau": "6", "bay": "7", "tam": "8", "chin": "9", "muoi": "10"}
GENERIC = {"shop", "mart", "store", "cn", "chi", "nhanh", "k", "kios", "kiosk", "so"}

_DIGIT_LETTERS, _ONE_FORM = str.maketrans("0158", "oisb"), str.maketrans("01l58", "oiisb")

#: Entities that a task holds with their index, and learnt writings of trades; a larger register is refused.
MOST_ENTITIES, MOST_ALIASES = 500_000, 100_000
#: Names that a Python worker remembers; beyond that it forgets all and goes on.
MOST_NAMES = 200_000


_NOBODY = np.empty(0, np.int32)


class _Fold(dict):
    def __missing__(self, code: int) -> str:
        self[code] = plain = "".join(c for c in shape_of(chr(code)) if unicodedata.category(c) != "Mn").lower().replace("đ", "d")
        return plain


_FOLDED = _Fold()


def fold(text: str) -> str:
    return " ".join(text.translate(_FOLDED).split())


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & places.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over both lengths; 1 for two empty strings."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def typed(word: str) -> list[str]:
    """Readings of a word in which accents or letters were typed as other keys: digits read as letters, accents typed as
    digits, accents typed as letters (doubled vowels, w, and a letter for the tone at the end)."""
    out = [word]
    if any(c.isdigit() for c in word):
        out += [re.sub(r"\d", "", word), word.translate(_DIGIT_LETTERS), word.replace("1", "l").translate(_DIGIT_LETTERS)]
    keys = re.sub(r"(?<=[aeiouyd])w|w(?=$)", "", re.sub(r"([aeod])\1", r"\1", word))
    keys = re.sub(r"w", "u", keys) if keys.startswith("w") else keys
    out += [keys, re.sub(r"[sfrxj]$", "", keys), re.sub(r"(?<=[aeiouy])[sfrxj]", "", keys)]
    return [w for w in dict.fromkeys(out) if w]


class Register:
    """What is known of the entities: their trades, titles and own words, and all words that occur."""

    def __init__(self, entities: list[tuple[str, str, str | None]], aliases: dict[str, str] | None = None) -> None:
        """``entities`` are (key, name, trade); ``aliases`` are further writings of trades, folded, with the trade they mean."""
        self.entities = entities
        self.trades = sorted({fold(t) for *_, t in entities if t and fold(t)})
        known = {t: t for t in self.trades} | {a: t for a, t in (aliases or {}).items() if t in self.trades and a not in self.trades}
        self.aliases = sorted(((a.split(), full) for a, full in known.items()), key=lambda x: (-len(x[0]), x[0]))
        self.longest_alias = max((len(a) for a, _ in self.aliases), default=0)
        self.alias_of = {tuple(a): full for a, full in self.aliases}
        self.trade_words = {w for words, _ in self.aliases for w in words}
        self.title_words = {w for v in TITLES.values() for w in v} | set(RANKS) | set(RANKS.values())
        self.own: set[str] = set()
        self.keys: list[str] = []
        self.parts: dict[str, tuple[str | None, str, tuple[str, ...]]] = {}
        for key, name, trade in entities:
            words = re.findall(r"[^\W_]+", fold(name))
            full = fold(trade) if trade else None
            if full and words[: len(full.split())] == full.split():
                rest = words[len(full.split()) :]
            else:
                said, rest = self._trade(words)
                full = full or said
            title, rest = self._title(rest)
            self.keys.append(key)
            self.parts[key] = full, title, tuple(rest)
        self.own = {w for _, _, rest in self.parts.values() for w in rest}
        self.words = self.own | self.trade_words | self.title_words | GENERIC
        self.longest = max(map(len, self.own), default=1)
        self.one_form: dict[str, str] = {}
        for w in sorted(self.words):
            self.one_form.setdefault(w.translate(_ONE_FORM), w)
        posted: dict[str, list[int]] = {}
        traded: dict[str | None, list[int]] = {}
        self.exact: dict[tuple[str, ...], list[int]] = {}
        for i, key in enumerate(self.keys):
            full, _, words = self.parts[key]
            traded.setdefault(full, []).append(i)
            self.exact.setdefault(words, []).append(i)
            for s in {w[at:] for w in words for at in range(len(w) - SHORTEST + 1)}:
                posted.setdefault(s, []).append(i)
        self.suffixes = {s: np.array(v, np.int32) for s, v in posted.items()}
        none = np.array(traded.get(None, []), np.int32)
        self.of_trade = {t: np.union1d(np.array(v, np.int32), none) for t, v in traded.items() if t}
        self.remembered: dict[str, str | None] = {}

    def _blocks(self, words: tuple[str, ...]) -> list[np.ndarray]:
        """For each word of the name the entities that share its shortest suffix; those that share a longer one are among them."""
        return [self.suffixes.get(w[-SHORTEST:], _NOBODY) for w in words if len(w) >= SHORTEST]

    def candidates(self, name: tuple[str | None, str, tuple[str, ...]]) -> np.ndarray:
        """Entities that share a suffix which isn't common, or a common one together with so many other fields of the name that few
        are left, or with all of them. What shares a common suffix and fewer fields is left to ``link``."""
        blocks = self._blocks(name[2])
        trade = self.of_trade.get(name[0])
        found: list[np.ndarray] = []

        def refine(block: np.ndarray, fields: list[np.ndarray], few: int, all_so_far: bool) -> None:
            if len(block) <= few or not fields and all_so_far:
                found.append(block)
                return
            for i, f in enumerate(fields):
                refine(np.intersect1d(block, f, assume_unique=True), fields[i + 1 :], COMMON_REFINED, all_so_far and i == 0)

        for i, block in enumerate(blocks):
            refine(block, [*([trade] if trade is not None else []), *blocks[:i], *blocks[i + 1 :]], COMMON, True)
        return np.unique(np.concatenate(found)) if found else _NOBODY

    def _fit(self, parts: tuple[str | None, str, tuple[str, ...]], entities: Iterable[int]) -> tuple[str | None, bool]:
        """(the entity that fits best, whether any fits); no entity if two fit equally."""
        best, second, at = 0.0, 0.0, ""
        for i in entities:
            score = self.score(parts, self.keys[i])
            if score > best:
                best, second, at = score, best, self.keys[i]
            elif score > second:
                second = score
        return (at if best > second + 1e-9 else None), best > 0

    def link(self, name: str) -> str | None:
        """The entity that fits best; none if nothing fits or two fit equally.

        Entities with exactly the name's words are compared first, then the candidates of the refined suffixes, and only if
        nothing fits all that share any suffix and don't have another trade.
        """
        if name not in self.remembered:
            if len(self.remembered) >= MOST_NAMES:
                self.remembered.clear()
            parts = self.parse(name)
            found, fits = self._fit(parts, self.exact.get(parts[2], ()))
            if not fits:
                tried = self.candidates(parts)
                found, fits = self._fit(parts, tried)
                if not fits:
                    rest = np.unique(np.concatenate([_NOBODY, *self._blocks(parts[2])]))
                    rest = np.setdiff1d(rest, tried, assume_unique=True)
                    found, _ = self._fit(parts, np.intersect1d(rest, self.of_trade[parts[0]], assume_unique=True) if parts[0] in self.of_trade else rest)
            self.remembered[name] = found
        return self.remembered[name]

    def beside(self, name: str) -> tuple[str, str, str] | None:
        """(what stands before or behind the exact own words of one entity, its trade, its key); nothing if there is something
        on both sides or nothing on either. Forms of address, figures and words for branches don't count."""
        words = re.findall(r"[^\W_]+", fold(name))
        for n in range(len(words) - 1, 1, -1):
            for at in range(len(words) - n + 1):
                own = self.exact.get(tuple(words[at : at + n]), ())
                if len(own) == 1:
                    full, _, _ = self.parts[self.keys[own[0]]]
                    left = [w for w in words[:at] if w not in self.title_words and not w.isdigit()]
                    right = [w for w in words[at + n :] if w not in GENERIC and w not in self.title_words and not w.isdigit()]
                    if full is None or bool(left) == bool(right):
                        return None
                    said = " ".join(left or right)
                    return None if said in self.alias_of else (said, full, self.keys[own[0]])
        return None

    def _trade(self, words: list[str]) -> tuple[str | None, list[str]]:
        """The trade at either end of the words, the longest writing first, and the other words."""
        for n in range(min(self.longest_alias, len(words) - 1), 0, -1):
            for part, rest in ((words[:n], words[n:]), (words[-n:], words[:-n])):
                full = self.alias_of.get(tuple(part))
                if full:
                    return full, rest
        for full in self.trades:
            n = len(full.split())
            for part, rest in ((words[:n], words[n:]), (words[-n:], words[:-n])):
                if len(words) > n + 1 and not any(w in self.own for w in part) and ratio("".join(part), full.replace(" ", "")) >= NAME_RATIO:
                    return full, rest
        return None, words

    def _title(self, words: list[str]) -> tuple[str, list[str]]:
        """The rank in a form of address at the start, and the other words."""
        if len(words) > 2 and any(words[0] in v for v in TITLES.values()) and (words[1] in RANKS or words[1] in RANKS.values()):
            return RANKS.get(words[1], words[1]), words[2:]
        return "", words

    def _spell(self, word: str) -> list[str]:
        """The word as known words: itself, a typed reading of it, a run of own words, or itself unknown."""
        readings = typed(word)
        for w in readings:
            if w in self.words:
                return [w]
        same = self.one_form.get(word.translate(_ONE_FORM))
        if same:
            return [same]
        for w in readings:
            if len(w) > 4:
                run = self._run(w)
                if run:
                    return run
        return [word]

    def _run(self, text: str) -> list[str] | None:
        best: list[list[str] | None] = [[]] + [None] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - self.longest), end):
                if best[start] is not None and text[start:end] in self.own and (best[end] is None or len(best[start]) + 1 < len(best[end])):
                    best[end] = [*best[start], text[start:end]]
        return best[-1] if best[-1] and len(best[-1]) > 1 else None

    def parse(self, name: str) -> tuple[str | None, str, tuple[str, ...]]:
        """(trade, title, own words) of a name as written."""
        name = unicodedata.normalize("NFC", name)
        text = "".join(" " + c if i and c.isupper() and name[i - 1].islower() and name[i + 1 : i + 2].islower() else c for i, c in enumerate(name))
        words = re.findall(r"[^\W_]+", fold(text))
        titles = {w for v in TITLES.values() for w in v}
        while len(words) > 1 and words[-1].isdigit() and not (words[-2] in titles and words[-1] in RANKS.values()):
            words.pop()
            while len(words) > 1 and (words[-1] in GENERIC or ratio(words[-1], "nhanh") >= 0.75 and words[-1] not in self.own):
                words.pop()
        words = [s for w in words for s in self._spell(w)]
        while len(words) > 1 and words[-1] in GENERIC:
            words.pop()
        trade, rest = self._trade(words)
        title, rest = self._title(rest)
        if trade is None:
            trade, rest = self._trade(rest)
        for at in range(1, len(words)) if trade is None else ():
            turned, others = self._trade(words[at:] + words[:at])
            if turned and others[-at:] == words[:at]:
                title, rest = self._title(others)
                if title or len(others) == at:
                    trade = turned
                    break
        return trade, title, tuple(rest)

    def score(self, name: tuple[str | None, str, tuple[str, ...]], key: str) -> float:
        """How well the parts of a name fit an entity: 0 if they don't; a name with left out or initial words scores less."""
        trade, title, words = name
        full, own_title, own = self.parts[key]
        if trade and full and trade != full or title and own_title != title or not words or not own:
            return 0.0
        bonus = 0.02 * (bool(trade) and trade == full) + 0.01 * (bool(title) and title == own_title)
        if len(words) == len(own):
            return self._whole(words, own, bonus, bool(trade))
        if len(words) == 1 or len(words) > len(own):
            joined, whole = "".join(words), "".join(own)
            if len(words) > len(own) and sum(w in self.own for w in words) > len(own):
                return 0.0
            r = ratio(joined, whole)
            return r - 0.1 + bonus if r >= 0.9 else 0.0
        if len(words) == len(own) - 1 and len(words) > 1:
            best = max(self._whole(words, own[:i] + own[i + 1 :], bonus, False) for i in range(len(own)))
            joined = ratio("".join(words), "".join(own))
            if joined >= 0.9 and not all(w in self.own for w in words):
                return joined - 0.1 + bonus
            return best - 0.3 if best and (trade or title) else 0.0
        return 0.0

    def _whole(self, words: tuple[str, ...], own: tuple[str, ...], bonus: float, initials: bool) -> float:
        total, letters = 0.0, 0
        for w, o in zip(words, own):
            if w == o:
                r = 1.0
            elif len(w) == 1 and initials and o.startswith(w) and len(o) > 1:
                r, letters = 0.8, letters + 1
            elif w in self.own:
                return 0.0
            else:
                r = max(ratio(t, o) for t in typed(w))
                if r < WORD_RATIO:
                    return 0.0
            total += r * len(o)
        total /= sum(map(len, own))
        if letters == len(words) or total < NAME_RATIO - 0.1 * bool(letters):
            return 0.0
        return total + bonus


def read_register(entities: DataFrame, key: str, name: str, trade: str) -> Register:
    """The register of a small table of entities; rows without a key or name are left out, a larger table is refused."""
    rows = entities.where(F.col(key).isNotNull() & F.col(name).isNotNull()).select(key, name, trade).distinct().limit(MOST_ENTITIES + 1).collect()
    if len(rows) > MOST_ENTITIES:
        raise ValueError(f"more than {MOST_ENTITIES} entities")
    return Register([(r[0], r[1], r[2]) for r in sorted(rows, key=lambda r: (r[0], r[1], r[2] or ""))])


def with_learnt_trades(names: DataFrame, register: Register, name: str = "name") -> Register:
    """The register with the writings of trades that all these names show.

    A text beside the exact own words of an entity speaks for its trade; it is a writing of the trade if at least
    ``ALIAS_ENTITIES`` entities of that trade have it, and they are at least ``ALIAS_SHARE`` of all that do. Texts are counted on
    the cluster; what comes to the driver are the writings that hold, whose number is checked.
    """
    shared = to_tasks(names.sparkSession, register)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([x for n in batch["name"].unique() if (x := shared.value.beside(n))], columns=["said", "trade", "key"])

    rows = names.where(F.col(name).isNotNull()).select(F.col(name).alias("name"))
    seen = spread(rows).mapInPandas(run, "said string, trade string, key string").groupBy("said", "trade").agg(F.countDistinct("key").alias("n"))
    held = seen.groupBy("said").agg(F.max_by("trade", F.struct("n", "trade")).alias("trade"), F.max("n").alias("n"), F.sum("n").alias("all"))
    aliases = held.where((F.col("n") >= ALIAS_ENTITIES) & (F.col("n") >= ALIAS_SHARE * F.col("all"))).select("said", "trade").limit(MOST_ALIASES + 1).collect()
    if len(aliases) > MOST_ALIASES:
        raise ValueError(f"more than {MOST_ALIASES} writings of trades")
    return Register(register.entities, {r[0]: r[1] for r in aliases})


def linked_names(names: DataFrame, register: Register, keep: tuple[str, ...], name: str = "name") -> DataFrame:
    """(keep, name, entity) of each row whose name is that of one entity; null, empty and ambiguous names give no row.

    The register with its index of suffixes has a bounded size and goes to every task, so rows aren't shuffled. Rows are kept
    as they come, repeats included; other columns than ``keep`` are ignored.
    """
    rows = names.where(F.col(name).isNotNull()).select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)], F.col(name).alias("name"))
    shared = to_tasks(names.sparkSession, register)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shared.value.link(n) for n in batch["name"]]
            batch = batch.assign(entity=pd.Series(found, index=batch.index, dtype=object))
            yield batch[batch["entity"].notna()]

    linked = spread(rows).mapInPandas(run, f"{kinds}, entity string")
    return linked.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("name").alias(name), "entity")
