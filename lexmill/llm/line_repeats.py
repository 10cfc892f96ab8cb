"""Lines repeated across the documents of one site, found with PrefixSpan and removed.

A document's lines become a sequence of item identifiers. A pattern is a sequence of items that stand in this order,
gaps allowed, in documents of at least ``min_pages`` distinct addresses of the site. PrefixSpan grows patterns from
frequent prefixes: each document in which a prefix stands is projected on what follows the prefix's leftmost place, and
the items there extend it. Levels follow until none has a frequent pattern; no length is too great.

A repeated block of n lines has 2^n - 1 subsequences, so only closed patterns are given: those of which no longer one
stands in the same documents. Two rules leave out the rest before it is grown, and lose no closed pattern:

- Jump: where what follows a prefix begins alike in all its documents, the prefix takes that whole beginning at once.
  It is what the least and the greatest of the projections have in common.
- Back scan: a prefix is left out if some item could be put into it, at one place, in each of its documents, since
  whatever grows from it then grows from the longer one too.

Every stage is keyed by (site, pattern), with partial aggregation before each shuffle; no site, line or document is
ever gathered in one task beyond the lines of a single row.

Two lines are the same item if they are equal after lower-casing, writing 0 for each run of digits and
dropping all but a-z and 0-9. Lines empty after that are no items.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.session import materialize
from lexmill.sources.tables import site_of


def line_form(line: Column) -> Column:
    """The form under which two lines count as the same."""
    return F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]+", "0"), "[^a-z0-9]+", "")


def line_items(chunks: DataFrame, id_col: str = "id", text_col: str = "text", url_col: str = "url") -> DataFrame:
    """(id, site, page, line_no, item) for each line that is an item; ``page`` and ``item`` are hashes.

    Rows without id, text or address with a host give nothing. ``item`` pairs two hash functions.
    """
    form = F.col("form")
    return (
        chunks.select(
            F.col(id_col).alias("id"),
            F.xxhash64(F.col(url_col)).alias("page"),
            site_of(F.col(url_col)).alias("site"),
            F.col(text_col).alias("text"),
        )
        .where(F.col("id").isNotNull() & F.col("site").isNotNull() & F.col("text").isNotNull())
        .select("id", "site", "page", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
        .select("id", "site", "page", (F.col("at") + 1).alias("line_no"), line_form(F.col("line")).alias("form"))
        .where(form != "")
        .select("id", "site", "page", "line_no", F.struct(F.xxhash64(form).alias("a"), F.hash(form).alias("b")).alias("item"))
    )


def _supported(occurrences: DataFrame, key: str, min_pages: int) -> DataFrame:
    """(site, key, pages) of the keys that stand on at least ``min_pages`` distinct pages of a site."""
    return (
        occurrences.select("site", key, "page")
        .distinct()
        .groupBy("site", key)
        .agg(F.count(F.lit(1)).alias("pages"))
        .where(F.col("pages") >= min_pages)
    )


def _sequences(items: DataFrame, frequent: DataFrame) -> DataFrame:
    """(id, site, page, codes, line_nos): the frequent items of each document in line order, an item as one number."""
    code = F.xxhash64("item.a", "item.b")
    rows = items.join(frequent.select("site", "item"), ["site", "item"], "left_semi").select("id", "site", "page", F.struct("line_no", code.alias("code")).alias("at"))
    lines = rows.groupBy("id", "site", "page").agg(F.array_sort(F.collect_set("at")).alias("lines"))
    return lines.select("id", "site", "page", F.transform("lines", lambda x: x["code"]).alias("codes"), F.transform("lines", lambda x: x["line_no"]).alias("line_nos"))


def _after(start: Column) -> Column:
    """What follows the place ``start`` (from 1) in a document."""
    return F.slice("codes", start + 1, F.size("codes"))


def _extended(places: DataFrame) -> DataFrame:
    """Each prefix's places (pattern, at) with every item that follows as the next one, at its first place."""
    last = F.coalesce(F.try_element_at("at", F.lit(-1)), F.lit(0))
    following = F.array_distinct(_after(last))
    grown = places.select("*", last.alias("last"), F.explode(following).alias("code"))
    at = (F.col("last") + F.array_position(_after(F.col("last")), F.col("code"))).cast("int")
    return grown.select("id", "site", "page", "codes", "line_nos", F.array_append("pattern", F.col("code")).alias("pattern"), F.array_append("at", at).alias("at"))


def _frequent(places: DataFrame, min_pages: int) -> DataFrame:
    """The places of the frequent patterns, each taken on to the end of what its documents go on with alike; with the
    pattern's numbers of pages and of documents."""
    rest = _after(F.element_at("at", -1))
    by_page = places.groupBy("site", "pattern", "page").agg(F.count(F.lit(1)).alias("n"), F.min(rest).alias("low"), F.max(rest).alias("high"))
    counted = by_page.groupBy("site", "pattern").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))
    pairs = F.zip_with("low", "high", lambda x, y: F.coalesce(x == y, F.lit(False)))
    alike = F.when(F.forall(pairs, lambda x: x), F.size(pairs)).otherwise(F.array_position(pairs, False) - 1).cast("int")
    patterns = counted.where(F.col("pages") >= min_pages).select("site", "pattern", "pages", "docs", F.slice("low", F.lit(1), alike).alias("more"))
    end = F.element_at("at", -1)
    steps = F.when(F.size("more") > 0, F.sequence(end + 1, end + F.size("more"))).otherwise(F.array().cast("array<int>"))
    return places.join(patterns, ["site", "pattern"]).select(
        "id", "site", "page", "codes", "line_nos", F.concat("pattern", "more").alias("pattern"), F.concat("at", steps).alias("at"), "pages", "docs"
    )


def _periods(from_whole: bool) -> Column:
    """Where items could be put in before each item of the pattern: between the leftmost place of the item before it, and
    the last place of its own from which the rest still follows, in the whole document or up to the leftmost place."""
    k = F.size("pattern")

    def step(acc: Column, i: Column) -> Column:
        before = F.slice("codes", F.lit(1), acc["bound"] - 1)
        own = F.when((i == k) & ~F.lit(from_whole), F.element_at("at", -1)).otherwise(acc["bound"] - F.array_position(F.reverse(before), F.element_at("pattern", i)))
        own = own.cast("int")
        first = F.when(i > 1, F.element_at("at", F.greatest(i - 1, F.lit(1)))).otherwise(0)
        items = F.array_distinct(F.slice("codes", first + 1, F.greatest(own - first - 1, F.lit(0))))
        return F.struct(own.alias("bound"), F.concat(acc["found"], F.transform(items, lambda x: F.struct(i.alias("gap"), x.alias("code")))).alias("found"))

    start = F.struct((F.size("codes") + 1).alias("bound"), F.array().cast("array<struct<gap:int,code:bigint>>").alias("found"))
    return F.aggregate(F.sequence(k, F.lit(1), F.lit(-1)), start, step, lambda acc: acc["found"])


def _judged(places: DataFrame) -> DataFrame:
    """(site, pattern, pages, docs, closed, alive) of each pattern: whether no longer one stands in the same documents, and
    whether it is to be grown."""
    ahead = F.transform(F.array_distinct(_after(F.element_at("at", -1))), lambda x: F.struct((F.size("pattern") + 1).alias("gap"), x.alias("code")))
    key = ["site", "pattern"]
    patterns = places.groupBy(*key).agg(F.first("pages").alias("pages"), F.first("docs").alias("docs"))
    seen = places.select(*key, "docs", F.explode(F.concat(F.transform(F.concat(_periods(True), ahead), lambda x: F.struct(x.alias("put"), F.lit(False).alias("early"))), F.transform(_periods(False), lambda x: F.struct(x.alias("put"), F.lit(True).alias("early"))))).alias("x"))
    everywhere = seen.groupBy(*key, "x").agg(F.count(F.lit(1)).alias("n"), F.first("docs").alias("docs")).where("n = docs")
    verdicts = everywhere.groupBy(*key).agg(F.max("x.early").alias("early"))
    return patterns.join(verdicts, key, "left").select(*key, "pages", "docs", F.col("early").isNull().alias("closed"), (~F.coalesce("early", F.lit(False))).alias("alive"))


def mined(chunks: DataFrame, min_pages: int, **columns: str) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """The documents' frequent items (id, site, page, codes, line_nos), and by level of growth the places (id, page,
    line_nos, pattern, at) of the frequent patterns and what is known of the patterns (pages, docs, closed)."""
    items = line_items(chunks, **columns)
    sequences = materialize(_sequences(items, _supported(items, "item", min_pages)))
    none = F.array().cast("array<bigint>")
    places = sequences.select("*", none.alias("pattern"), F.array().cast("array<int>").alias("at"))
    levels = []
    while True:
        now = materialize(_frequent(_extended(places), min_pages))
        if now.isEmpty():
            return sequences, levels
        patterns = materialize(_judged(now))
        levels.append((now, patterns))
        places = now.join(patterns.where("alive").select("site", "pattern"), ["site", "pattern"], "left_semi")


def repeated_lines(chunks: DataFrame, min_pages: int = 5, **columns: str) -> DataFrame:
    """(id, line_no) of every line that is part of an occurrence of a frequent pattern.

    A single line is a pattern of length one, of which each place counts; of longer patterns the leftmost places in each
    document are given, and their lines are frequent by themselves too.
    Repeated rows and repeated deliveries give each line once; an empty table gives an empty result.
    """
    sequences, levels = mined(chunks, min_pages, **columns)
    found = sequences.select("id", F.explode("line_nos").alias("line_no"))
    for places, _ in levels:
        found = found.unionByName(places.where(F.size("pattern") > 1).select("id", F.explode(F.transform("at", lambda k: F.element_at("line_nos", k))).alias("line_no")))
    return found.distinct()


def frequent_sequences(chunks: DataFrame, min_pages: int = 5, **columns: str) -> DataFrame:
    """(site, length, pages, docs, example_id, example_lines): the closed frequent patterns of each site with their
    numbers of distinct pages and of documents, and the first document where each stands, with its leftmost lines."""
    _, levels = mined(chunks, min_pages, **columns)
    found = None
    for places, patterns in levels:
        lines = F.transform("at", lambda k: F.element_at("line_nos", k))
        first = places.groupBy("site", "pattern").agg(F.min(F.struct("id", lines.alias("lines"))).alias("first"))
        rows = patterns.where("closed").join(first, ["site", "pattern"])
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        kind = "site string, length long, pages long, docs long, example_id string, example_lines string"
        return chunks.sparkSession.createDataFrame([], kind)
    return found.select(
        "site",
        F.size("pattern").cast("long").alias("length"),
        "pages",
        "docs",
        F.col("first.id").alias("example_id"),
        F.array_join(F.col("first.lines").cast("array<string>"), ",").alias("example_lines"),
    )


def without_repeated_lines(chunks: DataFrame, min_pages: int = 5, id_col: str = "id", text_col: str = "text", url_col: str = "url") -> DataFrame:
    """``chunks`` with ``text_clean`` (the text without its repeated lines) and ``lines_removed``.

    All rows and columns are kept; columns of these two names are replaced. A null text stays null.
    """
    found = (
        repeated_lines(chunks, min_pages, id_col=id_col, text_col=text_col, url_col=url_col)
        .groupBy("id")
        .agg(F.collect_set("line_no").alias("__gone"))
        .withColumnRenamed("id", "__of")
    )
    base = chunks.drop("text_clean", "lines_removed")
    joined = base.join(found, base[id_col] == found["__of"], "left").drop("__of")
    gone = F.coalesce(F.col("__gone"), F.array().cast("array<int>"))
    kept = F.filter(F.split(F.col(text_col), "\n", -1), lambda line, at: ~F.array_contains(gone, at + 1))
    return joined.withColumns({"text_clean": F.array_join(kept, "\n"), "lines_removed": F.size(gone).cast("long")}).drop("__gone")
