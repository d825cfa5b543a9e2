"""Consolidating pairwise matches into groups.

The links are reduced before they are solved: vertices with one link are stripped and chains of vertices with two links are
compressed by list ranking (pointer doubling), again and again until every vertex that is left has three links or more. This
core is contracted along each vertex's smallest neighbour, and all of it repeats until no link is left. Each removal is a
level, a table (vertex, parent) in the shared folder; labels are restored from the last level back to the first, and each
level's labels are a table too, so a plan reads one join however many levels there are.

Every step is a join or an aggregate over links; nothing is collected but counts. A vertex with very many links is one key
of an aggregate with map-side combine, and the probe side of the joins, which adaptive execution splits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.session import Workspace

#: Levels whose labels are restored in one job.
CHUNK = 3


def linked_groups(pairs: DataFrame, left: str, right: str, work: Workspace | None = None) -> DataFrame:
    """(vertex, root) for every vertex of ``pairs``: root is the smallest vertex linked with it directly or through others.

    Pairs may repeat and come in either direction. A pair with a null end links nothing and is left out; a pair of a vertex
    with itself links nothing and alone makes no row. Empty strings are vertices like others. No pairs give no rows; other
    columns are ignored, whatever their names.
    """
    work = work or Workspace(pairs.sparkSession, "groups")
    ends = pairs.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null and u <> v")
    links = ends.union(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    levels: list[DataFrame] = []
    step, stripped = 0, False
    while True:
        marked, seen = _mark(work, links, f"marked{step}")
        if not seen["n"]:
            break
        step, stripped = step + 1, bool(seen["leaves"]) and not stripped  # a long path of leaf after leaf is a chain
        if stripped:
            links, parents = _strip(marked)
        elif seen["chain"]:
            links, parents = _compress(work, marked, step)
        else:
            links, parents = _contract(work, marked, step)
        levels.append(parents)
    return _restore(work, levels, links)


_LEAF = "(({0} = 1) and ({1} > 1 or {2} > {3}))"
#: Vertices to strip: with one link; of a pair that is linked with nothing else, the larger.
_U_LEAF, _V_LEAF = _LEAF.format("du", "dv", "u", "v"), _LEAF.format("dv", "du", "v", "u")


def _mark(work: Workspace, links: DataFrame, name: str) -> tuple[DataFrame, dict]:
    """Links with the number of links and the smallest neighbour of both ends; counts of links, leaves and chain vertices.

    All that the next step removes can be told from a row of this table alone.
    """
    degrees = links.groupBy("u").agg(F.count(F.lit(1)).alias("d"), F.min("v").alias("low"))
    one, other = degrees.select(F.col("u").alias("x"), F.col("d").alias("du"), F.col("low").alias("lu")), degrees.select(F.col("u").alias("y"), F.col("d").alias("dv"), F.col("low").alias("lv"))
    marked = links.join(one, F.col("u") == F.col("x")).join(other, F.col("v") == F.col("y")).select("u", "v", "du", "lu", "dv", "lv")
    count = lambda rule: F.sum(F.expr(rule).cast("int"))
    return work.write(marked, name, F.count(F.lit(1)).alias("n"), count(_U_LEAF).alias("leaves"), count("du <= 2").alias("chain"))


def _strip(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Removes vertices with one link; the outcome is a selection of rows, so no table is made."""
    return marked.where(f"not {_U_LEAF} and not {_V_LEAF}").select("u", "v"), marked.where(_U_LEAF).select("u", F.col("v").alias("parent"))


def _compress(work: Workspace, marked: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Replaces each chain of vertices with at most two links by one link between its two ends.

    A row (v, side) points at the vertex that is reached from v on that side; ``exit`` is the side on which that vertex is
    left again, null where the pointer has arrived: at a vertex with three links or more, or, with ``to`` null, at a free
    end. Each doubling squares the pointers; a ring of chain vertices has no end, and its rows stop when no smallest vertex
    seen changes any more.
    """
    there = F.when(F.col("dv") <= 2, F.when(F.col("lv") == F.col("u"), 1).otherwise(0))
    ranks = marked.where("du <= 2").select("u", F.when(F.col("v") == F.col("lu"), 0).otherwise(1).alias("side"), F.col("v").alias("to"), there.alias("exit"), F.least("u", F.when(there.isNotNull(), F.col("v"))).alias("least"))
    ranks = ranks.union(marked.where("du = 1").select("u", F.lit(1), F.lit(None).cast(marked.schema["v"].dataType), F.lit(None).cast("int"), "u"))
    moving = F.sum(F.when(F.col("exit").isNotNull(), 1).otherwise(0)).alias("moving")
    turn, seen = 0, {"moving": 1, "changed": 1}
    while seen["moving"] and seen["changed"]:
        turn += 1
        new, seen = work.write(_hop(_hop(ranks.withColumn("changed", F.lit(0)))), f"ranks{step}.{turn}", moving, F.sum("changed").alias("changed"))
        work.drop(f"ranks{step}.{turn - 1}")
        ranks = new.drop("changed")
    chains = ranks.groupBy("u").agg(F.min("to").alias("one"), F.max("to").alias("other"), F.min("least").alias("least"), F.max(F.col("exit").isNotNull()).alias("ring"))
    parents = chains.select("u", F.when(F.col("ring") | F.col("one").isNull(), F.col("least")).otherwise(F.col("one")).alias("parent")).where("u <> parent")
    joined = chains.where("not ring and one <> other").select("one", "other").distinct()
    kept = marked.where("du > 2 and dv > 2").select("u", "v")
    return kept.union(joined).union(joined.select("other", "one")).distinct(), parents


def _hop(ranks: DataFrame) -> DataFrame:
    """Every pointer that hasn't arrived goes on to where the vertex that it points at points; ``changed`` counts the rows that
    have arrived now or have seen a smaller vertex."""
    onward = ranks.select(F.col("u").alias("w"), F.col("side").alias("out"), F.col("to").alias("to2"), F.col("exit").alias("exit2"), F.col("least").alias("least2"))
    hop = ranks.join(onward, (F.col("to") == F.col("w")) & (F.col("exit") == F.col("out")), "left")
    arrived = F.col("exit").isNull()
    changed = F.when(arrived | F.col("exit2").isNotNull() & (F.col("least2") >= F.col("least")), F.col("changed")).otherwise(1)
    return hop.select("u", "side", F.when(arrived, F.col("to")).otherwise(F.col("to2")).alias("to"), F.when(~arrived, F.col("exit2")).alias("exit"), F.least("least", "least2").alias("least"), changed.alias("changed"))


def _contract(work: Workspace, marked: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """Joins every vertex of the core with the smallest of itself and its neighbours, and follows those to their ends."""
    hooks = marked.select("u", F.least("u", "lu").alias("parent")).distinct()
    turn, moved = 0, 1
    while moved:
        turn += 1
        up = hooks.select(F.col("u").alias("p"), F.col("parent").alias("top"))
        jump = hooks.join(up, F.col("parent") == F.col("p")).select("u", F.col("top").alias("parent"), (F.col("top") != F.col("parent")).cast("int").alias("moved"))
        new, seen = work.write(jump, f"hooks{step}.{turn}", F.sum("moved").alias("moved"))
        work.drop(f"hooks{step}.{turn - 1}")
        hooks, moved = new.drop("moved"), seen["moved"]
    a, b = hooks.select(F.col("u").alias("p"), F.col("parent").alias("u2")), hooks.select(F.col("u").alias("q"), F.col("parent").alias("v2"))
    rest = marked.select("u", "v").join(a, F.col("u") == F.col("p")).join(b, F.col("v") == F.col("q")).where("u2 <> v2").select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct()
    return rest, hooks.where("u <> parent")


def _restore(work: Workspace, levels: list[DataFrame], links: DataFrame) -> DataFrame:
    """Labels from the last level back to the first, then the smallest vertex of each label. The labels of every ``CHUNK`` levels
    are a table, so no plan reads more than a fixed number of joins."""
    if not levels:
        return links.select(F.col("u").alias("vertex"), F.col("v").alias("root")).limit(0)
    done: list[str] = []
    for end in range(len(levels), 0, -CHUNK):
        fresh: DataFrame | None = None
        for parents in reversed(levels[max(0, end - CHUNK) : end]):
            above = [df for df in (work.read(*done) if done else None, fresh) if df is not None]
            labels = parents.select("u", F.col("parent").alias("root"))
            if above:
                top = reduce(DataFrame.union, above).select(F.col("u").alias("p"), F.col("root").alias("top"))
                labels = parents.join(top, F.col("parent") == F.col("p"), "left").select("u", F.coalesce("top", "parent").alias("root"))
            fresh = labels if fresh is None else fresh.union(labels)
        work.write(fresh, f"labels{end}")
        done.append(f"labels{end}")
    labels = work.read(*done)
    least = labels.groupBy("root").agg(F.min("u").alias("low")).select(F.col("root").alias("r"), F.least("root", "low").alias("least"))
    named = labels.join(least, F.col("root") == F.col("r")).select(F.col("u").alias("vertex"), F.col("least").alias("root"))
    return named.union(least.select(F.col("r").alias("vertex"), F.col("least").alias("root")))
