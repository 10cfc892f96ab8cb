"""Keywords handed down from hub pages to the pages below them."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import urls as U


def hub_keywords(pages: DataFrame, hubs: DataFrame, enough: int = 3) -> DataFrame:
    """(url, keywords): for each page, the words of those card headings of the hubs above it that share a word with
    the path segment below the hub, deepest hub first until ``enough`` words, then the words of its own path.

    ``pages`` has url, ``hubs`` has url and card_headings. Repeated addresses count once; a hub given twice counts
    once. Pages are exploded to their ancestors, joined to hubs by address, and folded by page.
    """
    own = pages.where("url IS NOT NULL").select("url").distinct()
    cards = hubs.where("url IS NOT NULL").groupBy("url").agg(F.max("card_headings").alias("cards")).withColumnRenamed("url", "hub")
    above = own.select("url", F.explode(U.ancestors(F.col("url"))).alias("a")).select("url", F.col("a.depth").alias("depth"), F.col("a.url").alias("hub"), X.keywords(F.replace(F.col("a.child"), F.lit("-"), F.lit(" "))).alias("segment"))
    matched = F.filter(F.transform(F.filter("cards", lambda c: c.isNotNull()), lambda c: X.keywords(c)), lambda k: F.arrays_overlap(k, F.col("segment")))
    found = above.join(cards, "hub").select("url", "depth", F.flatten(matched).alias("words"))
    levels = found.groupBy("url").agg(F.array_sort(F.collect_list(F.struct((-F.col("depth")).alias("order"), "words"))).alias("levels"))
    gained = F.aggregate("levels", F.array().cast("array<string>"), lambda acc, x: F.when(F.size(acc) >= enough, acc).otherwise(F.concat(acc, x["words"])))
    return own.join(levels, "url", "left").select("url", F.array_distinct(F.concat(F.coalesce(gained, F.array()), X.url_keywords(F.col("url")))).alias("keywords"))


def inherited_keywords(links: DataFrame, seeds: DataFrame, own_words: DataFrame) -> DataFrame:
    """(url, depth, keywords): keywords passed along links from the seeds, by breadth-first levels; the first arrival
    counts, and levels follow until one reaches no further page. ``links`` has parent, pos, child; ``own_words`` has url, words. Each level is one join and an anti-join,
    with its lineage cut."""
    from lexmill.session import materialize

    reached = materialize(
        seeds.where("url IS NOT NULL").select("url").distinct().join(own_words, "url", "left").select("url", F.lit(0).alias("depth"), F.coalesce("words", F.array().cast("array<string>")).alias("keywords"))
    )
    edge = reached
    for depth in count(1):
        arrived = (
            edge.join(links, edge["url"] == links["parent"])
            .groupBy("child")
            .agg(F.min(F.struct(edge["url"], "pos", "keywords")).alias("first"))
            .join(reached.select(F.col("url").alias("child")), "child", "left_anti")
            .join(own_words.withColumnRenamed("url", "child"), "child", "left")
            .select(F.col("child").alias("url"), F.lit(depth).alias("depth"), F.array_distinct(F.concat("first.keywords", F.coalesce("words", F.array()))).alias("keywords"))
        )
        edge = materialize(arrived)
        if edge.isEmpty():
            break
        reached = materialize(reached.unionByName(edge))
    return reached
