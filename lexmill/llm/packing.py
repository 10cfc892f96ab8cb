"""Containers of fixed capacity filled with whole texts: first-fit decreasing in randomised groups.

Texts are dealt by hash into groups of about ``group_items``; each group is packed by itself, in one task, with
first-fit decreasing. The first container with enough room is found in a tournament tree over the remaining
capacities, so an item costs the logarithm of the group's containers. Only ids and sizes reach the groups.
A group of thousands leaves about as little room unused as the whole would; the unused share is at most one
partly filled container a group above that. Texts over the capacity are cut at the capacity; only they are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Tournament:
    """Remaining capacities of up to ``bins`` containers; each inner node holds the most room below it."""

    def __init__(self, bins: int, capacity: int) -> None:
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Index of the first container with room for ``size``, which is taken from it."""
        at = 1
        while at < self.leaves:
            at *= 2
            if self.room[at] < size:
                at += 1
        found = at - self.leaves
        self.room[at] -= size
        while at > 1:
            at //= 2
            self.room[at] = max(self.room[2 * at], self.room[2 * at + 1])
        return found


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container of each item, numbered from 0; no item may be over the capacity. Ties go by position."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    tree = Tournament(len(sizes), capacity)
    out = np.empty(len(sizes), np.int64)
    for k in np.argsort(-sizes, kind="stable"):
        out[k] = tree.place(int(sizes[k]))
    return out


def pack(sizes: DataFrame, capacities: DataFrame, group_items: int = 8000, seed: int = 3) -> DataFrame:
    """(container_kind, capacity_tokens, container_id, doc_id, piece, pieces, token_from, tokens).

    ``sizes`` has doc_id and tokens; each id counts once. Every text comes out once for each kind of container,
    as one piece unless it is over the capacity. The kinds, a few configured rows, are read by the driver. Kinds without a positive capacity take nothing. Texts of no
    tokens are put where there is room. Empty tables give an empty result.
    """
    items = sizes.where("doc_id IS NOT NULL AND tokens IS NOT NULL").select("doc_id", F.col("tokens").cast("long").alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    kinds = capacities.where("container_kind IS NOT NULL AND capacity_tokens > 0").select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity_tokens")).distinct().collect()
    groups = max(1, -(-items.count() // group_items))
    dealt = items.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(groups)))

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        kind, capacity, part = key
        rows = rows.sort_values("doc_id", kind="stable")
        size = rows["tokens"].to_numpy()
        pieces = np.maximum(1, -(-size // capacity))
        owner = np.repeat(np.arange(len(rows)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        tokens = np.minimum(size[owner] - start, capacity)
        return pd.DataFrame(
            {
                "container_kind": kind,
                "capacity_tokens": capacity,
                "container_id": part * (1 << 32) + first_fit_decreasing(tokens, capacity),
                "doc_id": rows["doc_id"].to_numpy()[owner],
                "piece": piece,
                "pieces": pieces[owner],
                "token_from": start,
                "tokens": tokens,
            }
        )

    schema = "container_kind string, capacity_tokens long, container_id long, doc_id long, piece long, pieces long, token_from long, tokens long"
    if not kinds:
        return sizes.sparkSession.createDataFrame([], schema)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("long").alias("capacity_tokens")) for k, c in kinds]))
    spread = dealt.withColumn("kind", each).select("kind.container_kind", "kind.capacity_tokens", "part", "doc_id", "tokens")
    return spread.groupBy("container_kind", "capacity_tokens", "part").applyInPandas(fill, schema)


def fill_report(packed: DataFrame) -> DataFrame:
    """(container_kind, containers, tokens, unused_share) of a packing."""
    by_container = packed.groupBy("container_kind", "capacity_tokens", "container_id").agg(F.sum("tokens").alias("tokens"))
    total = by_container.groupBy("container_kind", "capacity_tokens").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"))
    return total.select("container_kind", "containers", "tokens", F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")), 6).alias("unused_share"))
