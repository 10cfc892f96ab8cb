"""Mixing sources to target weights by Pfair scheduling.

The size of the mixture is the largest at which every source can give its share without being repeated more than
it may. A source's texts, in random order and repeated as often as needed, are laid end to end and cut into blocks;
block k of a source that has n of all N blocks is released at floor(k N / n) and due by ceil((k + 1) N / n).
Earliest deadline first among the released blocks fills slot after slot, so that at any point a source is less
than one block from its weight. Slots are scheduled in frames, independent of each other: at the edges of a
frame every source stands within a block of its weight, at a count known beforehand, so frames are rows of a Spark
job and no list of blocks is gathered.

Running sums over a source's texts are taken in two steps, sums of hash buckets first, so that a source which
holds a third of all texts is summed by many tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def edge_counts(blocks: list[int], slot: int) -> list[int]:
    """Blocks that each source has had before a slot: its weight of the slots, rounded so that they add up to them.

    Rounding the weights' running sums keeps each within one block of its weight, and lets no source fall back
    between slots that are far enough apart for two of its blocks.
    """
    total, sums, had = sum(blocks), 0, []
    for n in blocks:
        had.append((sums + n) * slot // total - sums * slot // total)
        sums += n
    return had


def frame_slots(blocks: list[int], least: int) -> int:
    """Slots of a frame: at least ``least``, and enough for two blocks of the smallest source."""
    return max(least, -(-2 * sum(blocks) // min(blocks)))


def schedule_frame(blocks: list[int], first: int, last: int) -> list[tuple[int, int, int]]:
    """(source, block, slot) for the slots from ``first`` up to ``last``: earliest deadline first."""
    total = sum(blocks)
    at, until = edge_counts(blocks, first), edge_counts(blocks, last)
    waiting = [(at[s] * total // n, s) for s, n in enumerate(blocks) if at[s] < until[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    out = []
    for slot in range(first, last):
        while waiting and (waiting[0][0] <= slot or not ready):
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(at[s] + 1) * total // blocks[s]), s))
        s = heapq.heappop(ready)[1]
        out.append((s, at[s], slot))
        at[s] += 1
        if at[s] < until[s]:
            heapq.heappush(waiting, (at[s] * total // blocks[s], s))
    return out


def quotas(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, docs, tokens, quota): tokens that each source is to give.

    Sources without a positive target or without tokens have quota 0; the others' shares are scaled to add up to 1.
    """
    wanted = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    there = sizes.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("tokens").alias("tokens"))
    rows = wanted.join(there, "source", "left").na.fill(0, ["docs", "tokens"])
    usable = (F.col("tokens") > 0) & (F.coalesce("target_share", F.lit(0.0)) > 0) & (F.coalesce("max_repeats", F.lit(1)) > 0)
    whole = Window.partitionBy()
    share = F.when(usable, F.col("target_share") / F.sum(F.when(usable, F.col("target_share"))).over(whole))
    most = F.col("tokens") * F.coalesce("max_repeats", F.lit(1)) / F.col("share")
    return (
        rows.withColumn("share", share)
        .withColumn("quota", F.coalesce(F.floor(F.col("share") * F.min(most).over(whole) + 1e-6), F.lit(0)))
        .select("source", "target_share", "max_repeats", "docs", "tokens", "quota")
    )


def mix(sizes: DataFrame, targets: DataFrame, block_tokens: int = 2048, frame: int = 8192, bucket_docs: int = 20_000, seed: int = 5) -> DataFrame:
    """(slot, source, block, repeat, doc_id, tokens, starts_at): the mixture, in order of slot and starts_at.

    ``sizes`` has doc_id, source and tokens; each id counts once. ``starts_at`` counts the tokens of the source
    before the text; a text belongs to the block in which it starts, and is never cut. Texts without a source, and
    sources without a target, are not mixed. The number of sources is what the driver holds.
    """
    docs = sizes.where("doc_id IS NOT NULL AND source IS NOT NULL AND tokens IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("doc_id", "x.source", "x.tokens")
    plan = [r for r in quotas(docs, targets).where("quota > 0").orderBy("source").collect()]
    spark = sizes.sparkSession
    schema = "slot long, source string, block long, repeat int, doc_id long, tokens long, starts_at long"
    if not plan:
        return spark.createDataFrame([], schema)
    blocks = [-(-r.quota // block_tokens) for r in plan]
    names = [r.source for r in plan]
    sources = F.broadcast(
        spark.createDataFrame(
            [(r.source, r.tokens, r.quota, -(-r.quota // r.tokens), -(-r.docs // bucket_docs)) for r in plan],
            "source string, whole long, quota long, repeats long, buckets long",
        )
    )
    dealt = docs.join(sources, "source").withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("buckets")))
    sums = dealt.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    order = Window.partitionBy("source", "bucket").orderBy(F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    run = F.coalesce(F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = (
        dealt.withColumn("run", run)
        .join(starts, ["source", "bucket"])
        .withColumn("repeat", F.explode(F.sequence(F.lit(0), (F.col("repeats") - 1).cast("int"))))
        .withColumn("starts_at", F.col("repeat") * F.col("whole") + F.col("base") + F.col("run"))
        .where(F.col("starts_at") < F.col("quota"))
        .withColumn("block", F.floor(F.col("starts_at") / block_tokens))
    )
    total, span = sum(blocks), frame_slots(blocks, frame)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for f in batch["id"]:
                rows = schedule_frame(blocks, int(f) * span, min(int(f + 1) * span, total))
                yield pd.DataFrame([(names[s], k, slot) for s, k, slot in rows], columns=["source", "block", "slot"])

    slots = spark.range(-(-total // span)).mapInPandas(scan, "source string, block long, slot long")
    return laid.join(slots, ["source", "block"]).select("slot", "source", "block", F.col("repeat").cast("int").alias("repeat"), "doc_id", "tokens", "starts_at")


def share_report(mixture: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, texts, tokens, actual_share, most_repeats) of a mixture."""
    by_source = mixture.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum("tokens").alias("tokens"), (F.max("repeat") + 1).cast("long").alias("most_repeats"))
    rows = targets.where("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = rows.join(by_source, "source", "left").na.fill(0, ["texts", "tokens", "most_repeats"])
    return joined.withColumn("actual_share", F.round(F.col("tokens") / F.sum("tokens").over(Window.partitionBy()), 6))
