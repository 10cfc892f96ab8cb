"""Numbered queries with SQL agree with it; all run, with clashing extra columns and on empty tables too."""

import pytest

from lexmill.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_agrees_with_sql(name, agree):
    agree(catalog.QUERIES[name], catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_runs(name, spark, data):
    assert catalog.QUERIES[name](spark, data).count() > 0


@pytest.fixture(scope="module")
def empty(spark, data, tmp_path_factory):
    import os

    folder = tmp_path_factory.mktemp("empty")
    for file in os.listdir(data):
        spark.read.parquet(f"{data}/{file}").limit(0).write.parquet(str(folder / file))
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_empty_tables_give_empty_results(name, spark, empty):
    assert catalog.QUERIES[name](spark, empty).count() == 0


@pytest.fixture(scope="module")
def dirty(spark, data, tmp_path_factory):
    """The tables with rows of nothing but nulls, repeated rows, a very long text and extra columns."""
    import os

    from pyspark.sql import functions as F

    folder = tmp_path_factory.mktemp("dirty")
    for file in sorted(os.listdir(data)):
        rows = spark.read.parquet(f"{data}/{file}")
        few = rows.limit(40)
        nulls = few.limit(2).select(*[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        more = rows.unionByName(few).unionByName(nulls)
        if "text" in rows.columns:
            long = few.where("text IS NOT NULL").limit(1).withColumn("text", F.concat(F.repeat(F.lit("word, and more of it. "), 20_000), F.repeat(F.lit("x"), 300_000)))
            more = more.unionByName(long)
        clash = {c: F.lit("clash") for c in ("key", "node", "line", "at", "site", "n", "tokens", "subject_name_", "rank", "score", "odds", "bucket", "item", "piece") if c not in rows.columns}
        more.withColumns(clash).write.parquet(str(folder / file))
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_dirty_tables_do_not_break(name, spark, dirty):
    assert catalog.QUERIES[name](spark, dirty).count() > 0
