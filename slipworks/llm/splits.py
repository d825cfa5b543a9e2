"""Splits that keep related records together.

Records are tied by the keys they share. Keys are the nodes of a graph and a record with several keys links them;
hash-to-min finds the components: each node sends its cluster to the smallest node of it and that node to the others, until
nothing changes. Clusters are rows (node, member), never arrays, and a node stands for all records of a key, so that a key
with a third of all records is one node. Every record is joined to its component, and weighted rendezvous hashing assigns
components to splits: all components by the same rule, whatever their size.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slipworks.session import Workspace

#: Seeds that ``fitted_rule`` tries, and how often it moves their weights.
SEEDS, TURNS = 16, 8


def hash_to_min(links: DataFrame, left: str, right: str, work: Workspace | None = None) -> DataFrame:
    """(node, component): the component of each node is the smallest node in it. Null ends link nothing; a link of a node
    with itself makes it a component; no links give no rows."""
    work = work or Workspace(links.sparkSession, "clusters")
    ends = links.select(F.col(left).alias("node"), F.col(right).alias("member")).where("node is not null and member is not null")
    own = ends.select("node", F.col("node").alias("member")).union(ends.select("member", "member"))
    clusters = ends.union(ends.select("member", "node")).union(own).distinct()
    state = (F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("node", "member")).alias("x"))
    clusters, was = work.write(clusters, "clusters0", *state)
    turn, now = 0, None
    while was["n"] and now != was:
        was, turn = (now if now is not None else was), turn + 1
        least = clusters.groupBy("node").agg(F.min("member").alias("low")).select(F.col("node").alias("of"), "low")
        sent = clusters.join(least, F.col("node") == F.col("of"))
        new = sent.select(F.col("low").alias("node"), "member").union(sent.select(F.col("member").alias("node"), F.col("low").alias("member"))).distinct()
        clusters, now = work.write(new, f"clusters{turn}", *state)
        work.drop(f"clusters{turn - 1}")
    return clusters.groupBy("node").agg(F.min("member").alias("component"))


def group_number(group: Column) -> Column:
    """``g`` and 7 digits for a writing with a number in it, else the writing without blanks around it in lower case; null if
    null or blank."""
    digits = F.regexp_extract(group, r"(?U)^\s*\p{L}*\s*0*(\d+)\s*$", 1)
    plain = F.lower(F.regexp_replace(group, r"(?U)^\s+|\s+$", ""))
    return F.when(digits != "", F.concat(F.lit("g"), F.when(F.length(digits) < 7, F.lpad(digits, 7, "0")).otherwise(digits))).when(plain != "", plain)


def record_components(records: DataFrame, record: str, keys: list[Column], work: Workspace | None = None) -> DataFrame:
    """(record, component) of every distinct record: records that share a key, directly or through others, have one component.

    ``keys`` are strings; a record's keys are those of all its rows, and all of them are linked. A component is named by its
    least key. A record without any key has a null component, null records are left out. Records with one key, which most are,
    add no link, so only keys and the records with several of them enter the graph.
    """
    work = work or Workspace(records.sparkSession, "ties")
    pairs = records.where(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.explode_outer(F.array(*[k.cast("string") for k in keys])).alias("key")).distinct()
    pairs, _ = work.write(pairs, "pairs")
    ends = pairs.groupBy("record").agg(F.min("key").alias("low"), F.max("key").alias("high"))
    ends, seen = work.write(ends, "ends", F.sum((F.col("low") < F.col("high")).cast("int")).alias("linking"))
    links = ends.where("low is not null").select("low", F.col("low").alias("key")).distinct()
    if seen["linking"]:
        several = ends.where("low < high").select(F.col("record").alias("r"), "low")
        links = links.union(several.join(pairs.where("key is not null"), F.col("r") == F.col("record")).select("low", "key").distinct())
    of, _ = work.write(hash_to_min(links, "low", "key", work), "components")
    return ends.select("record", "low").join(of, F.col("low") == F.col("node"), "left").select("record", "component")


#: Kinds of nodes of ``torn_groups``: a group's name sorts before its writings, so it names the component.
_NAME, _WRITING = "0:", "1:"


def torn_groups(records: DataFrame, group: str, split: str, splits: tuple[str, ...] = ("train", "val", "test"), work: Workspace | None = None) -> DataFrame:
    """(group_id): the groups with records in at least two of ``splits``.

    Case and blanks of a split don't count; other splits, null splits and null or blank groups are left out. Nodes are the
    names of groups (``group_number``) and their writings; hash-to-min gives each writing its component, named by the name.
    """
    work = work or Workspace(records.sparkSession, "torn")
    name = F.lower(F.regexp_replace(split, r"(?U)\s+", ""))
    seen = records.select(F.col(group).alias("g"), name.alias("s")).where(F.col("s").isin(*splits)).where(group_number(F.col("g")).isNotNull()).distinct()
    seen, _ = work.write(seen, "seen")
    links = seen.select(F.concat(F.lit(_NAME), group_number(F.col("g"))).alias("a"), F.concat(F.lit(_WRITING), "g").alias("b")).distinct()
    of = hash_to_min(links, "a", "b", work).where(F.startswith("node", F.lit(_WRITING))).select(F.substring("node", 3, 1 << 30).alias("w"), F.substring("component", 3, 1 << 30).alias("group_id"))
    held = seen.join(of, F.col("g") == F.col("w")).groupBy("group_id").agg(F.min("s").alias("one"), F.max("s").alias("other"))
    return held.where("one < other").select("group_id")


def _chosen(unit: Column, weights: dict[str, Column], seed: Column) -> Column:
    """The split with the least -ln(u) / weight, u in (0, 1) by a hash of unit, split and seed."""

    def score(s: str) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(unit, F.lit(s), seed), 11)
        return -F.ln((bits.cast("double") + 0.5) / float(1 << 53)) / weights[s]

    return F.array_min(F.array(*[F.struct(score(s).alias("k"), F.lit(s).alias("s")) for s in sorted(weights)]))["s"]


def split_shares(targets: DataFrame, name: str = "split_name", share: str = "share") -> dict[str, float]:
    """The positive shares by split, scaled to a sum of 1; a split that is listed twice counts once, with its largest share."""
    shares = {r[0]: float(r[1]) for r in targets.where((F.col(share) > 0) & F.col(name).isNotNull()).groupBy(name).agg(F.max(share)).collect()}
    if not shares:
        raise ValueError("no split has a positive share")
    return {s: w / sum(shares.values()) for s, w in sorted(shares.items())}


class Rule(NamedTuple):
    """What decides a component's split besides its name: the seed of the hash and the weight of each split."""

    seed: int
    weights: dict[str, float]


def fitted_rule(units: DataFrame, shares: dict[str, float], seeds: int = SEEDS, turns: int = TURNS) -> Rule:
    """The rule by which rendezvous hashing comes nearest to the shares.

    ``units`` has unit and n, the records of a component. A component with a tenth of all records falls where its hash says,
    and leaves less room there for others. So the weights of each of ``seeds`` seeds are moved ``turns`` times against what its
    splits have too much or too little, each turn by one aggregate for all seeds; then the best is taken, of equals the first.
    All components count alike, whatever their size.
    """
    names, best = list(shares), (float("inf"), Rule(0, dict(shares)))
    weights = {k: dict(shares) for k in range(seeds)}
    for _ in range(turns):
        each = F.array(*[F.struct(F.lit(k).alias("seed"), *[F.lit(w).alias(f"w{i}") for i, w in enumerate(weights[k].values())]) for k in weights])
        tried = units.select("unit", "n", F.explode(each).alias("x")).select("n", "x.seed", _chosen(F.col("unit"), {s: F.col(f"x.w{i}") for i, s in enumerate(names)}, F.col("x.seed")).alias("s"))
        got: dict[int, dict[str, float]] = {}
        for r in tried.groupBy("seed", "s").agg(F.sum("n").alias("n")).collect():
            got.setdefault(r["seed"], {})[r["s"]] = float(r["n"])
        for k, sums in sorted(got.items()):
            total = sum(sums.values())
            off = sum(abs(sums.get(s, 0.0) / total - w) for s, w in shares.items())
            best = min(best, (off, Rule(k, dict(weights[k]))), key=lambda x: x[0])
            for s, w in shares.items():
                if w < 1:
                    weights[k][s] *= (w / max(sums.get(s, 0.0) / total, w / 4)) ** (0.5 / (1 - w))
    return best[1]


def assign_splits(records: DataFrame, record: str, keys: list[Column], shares: dict[str, float], rule: Rule | None = None, work: Workspace | None = None) -> DataFrame:
    """(record, component, split) for every distinct record; all of a component get one split.

    Weighted rendezvous hashing over components; a record without a key is a component of its own, with a null component in
    the result. Without a ``rule`` one is fitted to the shares; a rule that is kept and given again moves nothing as records
    and groups are added. Null records are left out; a record that occurs twice comes out once.
    """
    work = work or Workspace(records.sparkSession, "splits")
    of, _ = work.write(record_components(records, record, keys, work), "of")
    unit = F.coalesce(F.concat(F.lit("c:"), "component"), F.concat(F.lit("r:"), F.col("record").cast("string")))
    if rule is None:
        units, _ = work.write(of.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("n")), "units")
        rule = fitted_rule(units, shares)
    return of.select(F.col("record").alias(record), "component", _chosen(unit, {s: F.lit(w) for s, w in rule.weights.items()}, F.lit(rule.seed)).alias("split"))
