"""Filling containers of fixed capacity: vector bin packing by the dot-product heuristic.

An item needs room for its tokens, one segment and its loss-bearing tokens, and a container is limited in all three. A
container is filled by taking again and again the item that fits and has the largest dot product of what it needs and what
is left, each dimension weighted by how scarce it is. Items are spread over shards by a hash of their key, so many that no
shard is large and so few that the one container per shard that stays partly empty doesn't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slipworks.session import Workspace

#: Items that one task packs at a time.
SHARD = 8_000


def pack_items(tokens: np.ndarray, loss: np.ndarray, capacity: int, segments: int, loss_limit: int) -> list[list[int]]:
    """Indices of the items in each container. Every item must fit into an empty container.

    What an item needs and what a container has left are vectors of shares of the three limits: tokens, segments, loss-bearing
    tokens. A dimension weighs as much as all items together need of it, the scarcest 1. Items of one size are one row.
    """
    kinds, back = np.unique(np.stack([tokens, np.ones_like(tokens), loss], axis=1), axis=0, return_inverse=True)
    back = np.asarray(back).reshape(-1)
    waiting: list[list[int]] = [[] for _ in kinds]
    for i in range(len(tokens) - 1, -1, -1):
        waiting[back[i]].append(i)
    limits = np.array([capacity, segments, max(1, loss_limit)], dtype=np.int64)
    need = kinds / limits
    weights = need.T @ np.array([len(w) for w in waiting], dtype=float)
    weights = weights / max(weights.max(initial=0.0), 1e-9)
    live = np.arange(len(kinds))  # in order of tokens
    sizes, losses, needs = kinds[:, 0], kinds[:, 2], need
    out: list[list[int]] = []
    gone = 0
    while len(live) > gone:
        box, room = [], limits.copy()
        while room[1]:
            if gone * 2 > len(live):
                live = live[sizes >= 0]
                sizes, losses, needs, gone = kinds[live, 0], kinds[live, 2], need[live], 0
            until = int(np.searchsorted(kinds[live, 0], room[0], "right")) if gone else int(np.searchsorted(sizes, room[0], "right"))
            fits = np.flatnonzero((losses[:until] <= room[2]) & (sizes[:until] >= 0))
            if not len(fits):
                break
            at = int(fits[_best(needs[fits] @ (weights * room / limits), sizes[fits])])
            k = live[at]
            box.append(waiting[k].pop())
            room = room - kinds[k]
            if not waiting[k]:
                sizes = sizes.copy() if gone == 0 else sizes
                sizes[at], gone = -1, gone + 1
        out.append(box)
    return out


def _best(value: np.ndarray, tokens: np.ndarray) -> int:
    """The largest value, of equals the one with most tokens, of these the first."""
    top = np.flatnonzero(value == value.max())
    return int(top[tokens[top].argmax()])


def pack(sizes: DataFrame, limits: list[tuple[int, int, int, int]], work: Workspace | None = None) -> DataFrame:
    """(limit_id, container_id, doc_id, piece, tokens, loss): every item in one container of each limit.

    ``sizes`` has doc_id, tokens and loss; ``limits`` are (limit_id, capacity in tokens, segments, loss-bearing tokens). Only
    an item longer than the capacity is divided, into pieces of the capacity and a rest, numbered from 0; a full piece is a
    container of its own, and the loss-bearing tokens of an item are spread over its pieces from the first on. Items without
    tokens need no room and get one row with a null container. An item that alone bears more loss than the limit counts as
    the limit and shares its container only with items that bear none. Repeated keys are items of their own. No items give
    no rows.
    """
    work = work or Workspace(sizes.sparkSession, "packing")
    if not limits:
        raise ValueError("no limits")
    each = F.explode(F.array(*[F.struct(*(F.lit(int(x)).alias(n) for x, n in zip(row, ("limit_id", "capacity", "segments", "loss_limit")))) for row in limits]))
    items = sizes.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("long").alias("whole"), F.coalesce("loss", F.lit(0)).cast("long").alias("whole_loss"), each.alias("l")).select("doc_id", "whole", "whole_loss", "l.*")
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("whole") / F.col("capacity")) - 1).cast("int"))))
    done = F.col("piece").cast("long") * F.col("capacity")
    pieces = pieces.withColumn("tokens", F.least(F.col("capacity").cast("long"), F.col("whole") - done))
    pieces = pieces.withColumn("loss", F.least(F.greatest(F.lit(0), F.col("whole_loss") - done), F.col("tokens"), F.col("loss_limit").cast("long")))
    pieces, _ = work.write(pieces.select("limit_id", "capacity", "segments", "loss_limit", "doc_id", "piece", "tokens", "loss"), "pieces")
    alone = pieces.where("tokens >= capacity").select("limit_id", F.concat_ws("-", "limit_id", F.lit("full"), "doc_id", "piece").alias("container_id"), "doc_id", "piece", "tokens", "loss")
    empty = pieces.where("tokens = 0").select("limit_id", F.lit(None).cast("string").alias("container_id"), "doc_id", "piece", "tokens", "loss")
    loose = pieces.where("tokens > 0 and tokens < capacity")
    counts = {r[0]: r[1] for r in loose.groupBy("limit_id").count().collect()}
    shards = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(-(-n // SHARD)))]) if counts else F.create_map(F.lit(0), F.lit(1))
    loose = loose.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece"), F.coalesce(shards[F.col("limit_id")], F.lit(1)).cast("long")).cast("int"))

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece"], kind="stable").reset_index(drop=True)
        first = rows.iloc[0]
        boxes = pack_items(rows["tokens"].to_numpy(), rows["loss"].to_numpy(), int(first["capacity"]), int(first["segments"]), int(first["loss_limit"]))
        name = np.empty(len(rows), dtype=object)
        for k, box in enumerate(boxes):
            name[box] = f"{first['limit_id']}-{first['shard']}-{k}"
        return rows[["limit_id"]].assign(container_id=name, doc_id=rows["doc_id"], piece=rows["piece"], tokens=rows["tokens"], loss=rows["loss"])

    kind = sizes.schema["doc_id"].dataType.simpleString()
    packed = loose.groupBy("limit_id", "shard").applyInPandas(shard, f"limit_id int, container_id string, doc_id {kind}, piece int, tokens long, loss long")
    return packed.union(alone).union(empty)


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """(limit_id, containers, tokens, fill): how full the containers of each limit are."""
    room = F.create_map(*[x for k, v in capacities.items() for x in (F.lit(k), F.lit(v))])
    boxes = packed.where("container_id is not null").groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("tokens"))
    out = boxes.groupBy("limit_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return out.select("limit_id", "containers", "tokens", F.round(F.col("tokens") / (F.col("containers") * room[F.col("limit_id")]), 4).alias("fill"))
