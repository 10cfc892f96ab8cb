"""Packing sections into chunks: ordered folds over arrays, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.config import Settings
from lexmill.functions import text as X
from lexmill.functions import urls as U

_SECTION = "struct<heading:string,content:string>"


def merged(sections: Column, limit: int) -> Column:
    """Small sections joined while they fit the limit; the first heading that is not empty stays.

    ``sections`` is an array of (heading, content) in order.
    """
    none = F.array().cast(f"array<{_SECTION}>")
    start = F.struct(F.lit("").alias("heading"), F.lit("").alias("content"), F.lit(0).alias("size"), none.alias("done"))

    sized = F.transform(sections, lambda s: F.struct(s["heading"].alias("heading"), s["content"].alias("content"), X.token_count(s["content"]).alias("size")))

    def step(acc: Column, s: Column) -> Column:
        size = s["size"]
        fits = acc["size"] + size <= limit
        closed = F.when(acc["content"] != "", F.array_append(acc["done"], F.struct(acc["heading"].alias("heading"), acc["content"].alias("content")))).otherwise(acc["done"])
        joined = F.when(acc["content"] != "", F.concat(acc["content"], F.lit("\n\n"), s["content"])).otherwise(s["content"])
        return F.struct(
            F.when(fits, F.when(acc["heading"] != "", acc["heading"]).otherwise(s["heading"])).otherwise(s["heading"]).alias("heading"),
            F.when(fits, joined).otherwise(s["content"]).alias("content"),
            F.when(fits, acc["size"] + size).otherwise(size).alias("size"),
            F.when(fits, acc["done"]).otherwise(closed).alias("done"),
        )

    last = lambda acc: F.when(acc["content"] != "", F.array_append(acc["done"], F.struct(acc["heading"].alias("heading"), acc["content"].alias("content")))).otherwise(acc["done"])
    return F.aggregate(sized, start, step, last)


def packed(text: Column, limit: int, least: int) -> Column:
    """A text's sentences packed into pieces up to the limit; pieces below ``least`` tokens are left out.

    A sentence above the limit stays whole.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("now"), F.lit(0).alias("size"), none.alias("done"))

    sized = F.transform(X.sentences(text), lambda s: F.struct(s.alias("s"), X.token_count(s).alias("size")))

    def step(acc: Column, x: Column) -> Column:
        s, size = x["s"], x["size"]
        full = (acc["size"] + size > limit) & (acc["now"] != "")
        return F.struct(
            F.when(full, s).when(acc["now"] != "", F.concat(acc["now"], F.lit(" "), s)).otherwise(s).alias("now"),
            F.when(full, size).otherwise(acc["size"] + size).alias("size"),
            F.when(full, F.array_append(acc["done"], acc["now"])).otherwise(acc["done"]).alias("done"),
        )

    pieces = F.aggregate(sized, start, step, lambda acc: F.array_append(acc["done"], acc["now"]))
    return F.filter(F.transform(pieces, X.spaces), lambda p: X.token_count(p) >= least)


def chunked(sections: Column, limit: int, least: int) -> Column:
    """Sections merged, those above the limit packed by sentence, those below ``least`` left out."""

    def cut(s: Column) -> Column:
        size = X.token_count(s["content"])
        alone = F.when(size >= least, F.array(s["content"])).otherwise(F.array().cast("array<string>"))
        pieces = F.when(size <= limit, alone).otherwise(packed(s["content"], limit, least))
        return F.transform(pieces, lambda p: F.struct(s["heading"].alias("heading"), p.alias("content")))

    return F.flatten(F.transform(merged(sections, limit), cut))


def page_chunks(sections: DataFrame, pages: DataFrame, keywords: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Chunk rows of every page: ``sections`` (key, pos, heading, content), ``pages`` (key, url, title), and the
    keywords of addresses (url, keywords), or those of the path where there are none."""
    settings = settings or Settings.from_env()
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "heading", "content"))), lambda s: F.struct(s["heading"], s["content"]))
    by_page = sections.groupBy("key").agg(ordered.alias("sections"))
    rows = by_page.join(pages.groupBy("key").agg(F.min(F.struct("url", "title")).alias("p")).select("key", "p.*"), "key")
    chunks = rows.withColumn("chunks", chunked(F.col("sections"), settings.chunk_max_tokens, settings.chunk_min_tokens))
    flat = chunks.select("url", X.page_title(F.coalesce("title", F.lit(""))).alias("title"), F.size("chunks").alias("chunk_total"), F.posexplode("chunks").alias("chunk_index", "chunk"))
    if keywords is not None:
        flat = flat.join(keywords.select("url", F.col("keywords").alias("__k")), "url", "left")
    words = F.coalesce("__k", X.url_keywords(F.col("url"))) if keywords is not None else X.url_keywords(F.col("url"))
    return flat.select(
        X.chunk_id(F.col("url"), F.col("chunk_index")).alias("id"),
        "url",
        "title",
        F.col("chunk.heading").alias("section_heading"),
        U.breadcrumb(F.col("url")).alias("breadcrumb"),
        words.alias("keywords"),
        X.heading_prefix(F.col("title"), F.col("chunk.heading")).alias("heading_prefix"),
        F.col("chunk.content").alias("text"),
        "chunk_index",
        "chunk_total",
        X.token_count(F.col("chunk.content")).alias("approx_tokens"),
    )
