"""Retrieval quality: ranks of expected addresses, keyword recall, metrics by group, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Ranges into which the values of a group are cut for ranks, and groups up to which their bounds are broadcast.
RANGES = 200
MOST_GROUPS = 1000


def matches(url: Column, fragments: Column) -> Column:
    """Whether an address contains any fragment, case apart."""
    return F.exists(F.coalesce(fragments, F.array().cast("array<string>")), lambda f: F.contains(F.lower(F.coalesce(url, F.lit(""))), F.lower(f)))


def ranks(questions: DataFrame, results: DataFrame, order: str = "pick") -> DataFrame:
    """One row per question: rank of the first result that matches (null if none; 1 where nothing is expected), mrr,
    hit, and the share of expected keywords that stand in the results' texts.

    ``questions``: qid, fragments, answer_words and any groups; ``results``: qid, url, text, order.
    """
    joined = questions.join(results.select("qid", F.col("url").alias("__url"), F.col("text").alias("__text"), F.col(order).alias("__k")), "qid", "left")
    hit = F.when(matches(F.col("__url"), F.col("fragments")), F.col("__k"))
    keep = [c for c in questions.columns if c != "qid"]
    word_found = F.transform(F.coalesce("answer_words", F.array().cast("array<string>")), lambda w: F.contains(F.lower(F.coalesce("__text", F.lit(""))), F.lower(w)).cast("int"))
    by_text = joined.withColumn("__rank", hit).withColumn("__found", word_found)
    any_of = F.aggregate(F.collect_list("__found"), F.transform(F.first(F.coalesce("answer_words", F.array().cast("array<string>"))), lambda w: F.lit(0)), lambda acc, x: F.zip_with(acc, x, lambda a, b: F.greatest(a, b)))
    rows = by_text.groupBy("qid").agg(*[F.first(c).alias(c) for c in keep], F.min("__rank").alias("rank"), any_of.alias("__any"))
    free = F.size(F.coalesce("fragments", F.array().cast("array<string>"))) == 0
    rank = F.when(free, 1).otherwise(F.col("rank"))
    found = F.aggregate("__any", F.lit(0), lambda a, x: a + x)
    return rows.withColumn("rank", rank.cast("long")).withColumn("hit", F.col("rank").isNotNull()).withColumn("mrr", F.coalesce(1 / F.col("rank"), F.lit(0.0))).withColumn("kw_recall", found / F.greatest(F.size("__any"), F.lit(1))).drop("__any")


def _summary() -> list[Column]:
    part = lambda c: F.round(F.avg(F.when(c, 1.0).otherwise(0.0)), 6)
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if("hit").alias("hits"),
        part(F.col("hit")).alias("hit_rate"),
        F.round(F.avg("mrr"), 6).alias("mrr"),
        part(F.coalesce(F.col("rank") <= 1, F.lit(False))).alias("r1"),
        part(F.coalesce(F.col("rank") <= 3, F.lit(False))).alias("r3"),
        part(F.coalesce(F.col("rank") <= 5, F.lit(False))).alias("r5"),
        F.round(F.avg("kw_recall"), 6).alias("kw_recall"),
    ]


def metrics(ranked: DataFrame) -> DataFrame:
    return ranked.agg(*_summary())


def by_group(ranked: DataFrame, first: str = "tier", second: str = "category") -> DataFrame:
    """Metrics over all, by the first and by the second grouping, in one pass."""
    sets = ranked.groupingSets([[], [first], [second]], first, second)
    return sets.agg(*_summary())


def report(ranked: DataFrame, compared: DataFrame | None = None, grades: DataFrame | None = None) -> DataFrame:
    """One row for a set of questions: timestamp, n, retrieval (rounded metrics), tiers (by name), search_comparison (by
    search: hits, total, mrr), answer_quality (by dimension) and the questions' results.

    A set of questions is written by hand and bounded; ``results`` gathers its rows.
    """
    short = lambda c: F.round(c, 3)
    whole = metrics(ranked).select("n", F.struct(short("hit_rate").alias("hit_rate"), short("mrr").alias("mrr"), *(short(c).alias(c) for c in ("r1", "r3", "r5")), short("kw_recall").alias("kw")).alias("retrieval"))
    pairs = lambda rows, name, value: rows.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("m"))
    by_tier = ranked.where("tier IS NOT NULL").groupBy("tier").agg(*_summary())
    tiers = pairs(by_tier, "tier", F.struct(short("hit_rate").alias("hit"), short("mrr").alias("mrr"))).select(F.col("m").alias("tiers"))
    results = ranked.agg(F.array_sort(F.collect_list(F.struct("qid", *(c for c in ("tier", "category", "rank", "hit", "mrr", "kw_recall") if c in ranked.columns)))).alias("results"))
    row = whole.crossJoin(tiers)
    if compared is not None:
        row = row.crossJoin(pairs(compared, "search", F.struct("hits", "total", "mrr")).select(F.col("m").alias("search_comparison")))
    if grades is not None:
        row = row.crossJoin(pairs(grades, grades.columns[0], F.col("mean")).select(F.col("m").alias("answer_quality")))
    return row.crossJoin(results).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "*")


def p95(value: Column) -> Column:
    """The value at index floor(0.95 n) in order, not interpolated; for bounded groups."""
    values = F.array_sort(F.collect_list(value))
    return F.get(values, F.floor(F.size(values) * F.lit(0.95)).cast("int"))


def latency(log: DataFrame, group: str, value: str, id_col: str) -> DataFrame:
    """(group, n, avg_value, p95_value) of any number of rows by exact rank, without gathering a group.

    Distinct values are counted in ranges that hold about a two-hundredth of a group each, and only the range with the
    sought rank is ranked.
    """
    from pyspark.sql import Window

    rows = log.where(F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    # Ranges of about equal numbers of rows, whatever the values; their bounds are a sketch's, their counts are exact.
    bounds = rows.groupBy("g").agg(F.array_distinct(F.percentile_approx("v", [k / RANGES for k in range(1, RANGES)], 10 * RANGES)).alias("bounds"))
    bounded = rows.groupBy("g", "v").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(bounds) if bounds.count() <= MOST_GROUPS else bounds, "g")
    counts = bounded.select("g", "v", "n", F.size(F.filter("bounds", lambda x: x <= F.col("v"))).alias("b"))
    sums = counts.groupBy("g", "b").agg(F.sum("n").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy("g"))
    ranged = sums.withColumn("before", before).withColumn("sought", F.floor(total * F.lit(0.95)))
    at = ranged.where((F.col("sought") >= F.col("before")) & (F.col("sought") < F.col("before") + F.col("n"))).select("g", "b", "before", "sought")
    inside = counts.join(at, ["g", "b"])
    upto = F.sum("n").over(Window.partitionBy("g").orderBy("v")) + F.col("before")
    found = inside.withColumn("upto", upto).where("upto > sought").groupBy("g").agg(F.min("v").alias("p95_value"))
    averages = rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("avg_value"))
    return averages.join(found, "g").select(F.col("g").alias(group), "n", "avg_value", "p95_value")


def graded(grades: DataFrame, dimension: str, grade: str) -> DataFrame:
    """(dimension, n, mean, perfect, failed) of grades 0 to 2; negative grades are failures to grade and left out."""
    rows = grades.where(F.col(grade) >= 0)
    return rows.groupBy(dimension).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(grade), 6).alias("mean"), F.count_if(F.col(grade) == 2).alias("perfect"), F.count_if(F.col(grade) == 0).alias("failed"))
