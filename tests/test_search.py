import math
import random

import pytest
from pyspark.sql import functions as F

from lexmill.config import Settings
from lexmill.operators import dense, evaluation, fusion, sparse


def bm25(queries, docs, k1=1.5, b=0.75):
    words = {i: t.lower().split() for i, t in docs}
    n, avg = len(docs), sum(map(len, words.values())) / max(1, len(docs))
    df = {}
    for w in words.values():
        for t in set(w):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        for i, w in words.items():
            s = sum(math.log((n - df[t] + 0.5) / (df[t] + 0.5) + 1) * w.count(t) * (k1 + 1) / (w.count(t) + k1 * (1 - b + b * len(w) / avg)) for t in text.lower().split() if t in df)
            if s > 0:
                out[q, i] = round(s, 6)
    return out


def test_bm25_with_repeated_and_unknown_terms(spark):
    docs = [(0, "tax return return"), (1, "Tax file number"), (2, ""), (3, "super fund fees and tax")]
    queries = [(7, "tax tax return zzz"), (8, "zzz"), (9, "")]
    index = sparse.index(spark.createDataFrame(docs, "idx long, text string"))
    got = sparse.search(spark.createDataFrame(queries, "qid long, text string"), index, 10).collect()
    assert {(r.qid, r.idx): r.bm25_score for r in got} == pytest.approx(bm25(queries, docs), abs=2e-6)
    assert [r.rank for r in sorted(got, key=lambda r: r.rank)] == [1, 2, 3]


def test_bm25_of_an_empty_corpus(spark):
    index = sparse.index(spark.createDataFrame([], "idx long, text string"))
    assert sparse.search(spark.createDataFrame([(1, "a")], "qid long, text string"), index, 5).count() == 0


def test_dense_search_is_exact(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(300)] + [(900, None), (901, [1.0]), (5, [0.0] * 8)]
    corpus = spark.createDataFrame(rows[:302], "idx long, vec array<float>").repartition(3)
    queries = spark.createDataFrame(rows[:7], "qid long, vec array<float>")
    got = dense.search(queries, corpus, 5, size=8, block=64).collect()
    for q, v in rows[:7]:
        best = sorted(((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in rows[:300]))[:5]
        assert [r.idx for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [i for _, i in best]


def test_bm25_in_slices_is_the_same(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choice("tax fee return file super the of to".split()) for _ in range(rng.randint(0, 9)))) for k in range(90)]
    queries = [(q, " ".join(rng.choice("tax fee the the zz return".split()) for _ in range(5))) for q in range(12)]
    index = sparse.index(spark.createDataFrame(docs, "idx long, text string"))
    got = sparse.search(spark.createDataFrame(queries, "qid long, text string"), index, 7, slice_docs=20, slice_queries=5).collect()
    true = bm25(queries, docs)
    for q, _ in queries:
        best = sorted((-s, i) for (p, i), s in true.items() if p == q)[:7]
        assert [r.idx for r in sorted((r for r in got if r.qid == q), key=lambda r: r.rank)] == [i for _, i in best]


def test_bm25_gathers_no_row_for_each_document_of_a_common_word(spark):
    """Every document has the word; the rows that the ranking gets are k for each query and slice of documents."""
    index = sparse.index(spark.range(3000).selectExpr("id AS idx", "'tax' AS text"))
    found = sparse.search(spark.range(20).selectExpr("id AS qid", "'tax' AS text"), index, 5)
    assert [r.idx for r in found.where("qid = 3").orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInPandas" in plan and "sum(" not in plan.split("FlatMapCoGroupsInPandas")[0]


def test_dense_search_keeps_the_least_keys_of_ties(spark):
    """All rows are equal and none is better: only k rows of a query leave a task, and the least idx win."""
    corpus = spark.range(500).selectExpr("id AS idx", "array(1.0f, 0.0f) AS vec").repartition(3)
    got = dense.search(corpus.where("idx < 4").withColumnRenamed("idx", "qid"), corpus, 6, size=2, block=16).collect()
    assert sorted((r.qid, r.rank, r.idx) for r in got) == [(q, k + 1, k) for q in range(4) for k in range(6)]


def test_dense_queries_are_gathered_and_equal_ones_compared_once(spark):
    """Queries of many partitions make one block, in which a vector that several of them share stands once."""
    rng = random.Random(4)
    vecs = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(10)]
    queries = spark.createDataFrame([(k, vecs[k % 10]) for k in range(40)], "qid long, vec array<float>").repartition(8)
    corpus = spark.createDataFrame([(k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(200)], "idx long, vec array<float>").repartition(3)
    blocks = dense._blocks(queries, "qid", 8, 64, "q", parts=1).collect()
    assert len(blocks) == 1 and len(blocks[0].q_keys) == 40 and len(blocks[0].q_data) == 10 * 8 * 4
    got = {(r.qid, r["rank"]): (r.idx, r.dense_score) for r in dense.search(queries, corpus, 5, size=8, block=64, unique=True).collect()}
    assert len(got) == 200 and all(got[q, n] == got[q % 10, n] for q, n in got)


def test_dense_scores_closer_than_single_precision(spark):
    """Single precision only tells which pairs can count; lengths out of its range are compared in double precision."""
    corpus = spark.range(400).selectExpr("id AS idx", "array(1.0f, cast(id * 1e-8 AS float)) AS vec").repartition(2)
    queries = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1e25, 0.0])], "qid long, vec array<float>")
    got = dense.search(queries, corpus, 3, size=2, block=128).orderBy("qid", "rank").collect()
    assert [r.idx for r in got] == [399, 398, 397, 0, 1, 2]
    assert [r.dense_score for r in got[:3]] == pytest.approx([1 + n * 1e-8 for n in (399, 398, 397)], abs=2e-9)


def test_bm25_answers_queries_of_the_same_terms_once(monkeypatch):
    """Ranked once for each set of terms; common words and rare ones give what plain sums give."""
    import numpy as np
    import pandas as pd

    rng, ranked = random.Random(5), []
    rows = [(i, t, rng.random()) for t, n in (("all", 1000), ("half", 500), ("few", 90), ("one", 3)) for i in sorted(rng.sample(range(1000), n))]
    asked = [(q, t, 1 + (t == "half")) for q in range(40) for t in (("all", "half", "few"), ("all", "one"), ("few", "none"), ("half",))[q % 4]]
    lexsort = np.lexsort
    monkeypatch.setattr(np, "lexsort", lambda keys: ranked.append(1) or lexsort(keys))
    got = sparse._scorer(7, "long", "long")[0](pd.DataFrame(rows, columns=["idx", "term", "gain"]), pd.DataFrame(asked, columns=["qid", "term", "times"]))
    # the queries' own order may be made by it as well
    assert len(ranked) <= 5
    for q in range(40):
        sums = {}
        for _, term, times in sorted(a for a in asked if a[0] == q):
            for i, t, gain in rows:
                if t == term:
                    sums[i] = sums.get(i, 0.0) + times * gain
        best = sorted((-round(v, 6), i) for i, v in sums.items())[:7]
        assert [(-r.bm25_score, r.idx) for r in got[got.qid == q].itertuples()] == best


def _seconds(rows):
    import time

    rows.write.format("noop").mode("overwrite").save()
    start = time.perf_counter()
    rows.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def test_lengths_and_words_are_computed_once_a_row(spark):
    """A hundred times as many elements may not cost their square; each would be minutes if computed once an element."""
    from lexmill.functions import vectors as V

    long = spark.range(4, numPartitions=4).select(F.sequence(F.lit(1), F.lit(8000)).cast("array<float>").alias("v"))
    assert _seconds(long.select(V.unit(F.col("v")))) < 10
    weights = F.transform(F.sequence(F.lit(1), F.lit(1000)), lambda k: F.struct(F.concat(F.lit("w"), k).alias("term"), F.lit(1.0).alias("idf")))
    texts = spark.range(4, numPartitions=4).select(weights.alias("w"), F.repeat(F.concat(F.lit("x y "), F.col("id")), 20_000).alias("t"))
    assert _seconds(texts.select(fusion.weighted_overlap(F.col("w"), F.col("t")))) < 20


def test_pair_scores_look_at_each_word_of_a_text_once(spark):
    """Terms times words would be 200 million comparisons a row."""
    weights = F.transform(F.sequence(F.lit(1), F.lit(5000)), lambda k: F.struct(F.concat(F.lit("w"), k).alias("term"), F.lit(1.0).alias("idf")))
    texts = spark.range(4, numPartitions=4).select(weights.alias("w"), F.repeat(F.concat(F.lit("x y "), F.col("id")), 20_000).alias("t"))
    assert _seconds(texts.select(fusion.weighted_overlap(F.col("w"), F.col("t")))) < 3
    some = spark.sql("SELECT array(named_struct('term', 'a', 'idf', 1D), named_struct('term', 'b', 'idf', 3D)) AS w, '\u00a0B\u2003c ' AS t")
    assert some.select(fusion.weighted_overlap(F.col("w"), F.lit(None), F.col("t"))).first()[0] == 5.0


def candidates(spark, rows):
    return spark.createDataFrame(rows, "qid long, idx long, score double, pos long, url string, title string, query string, text string, vec array<double>")


def test_reciprocal_rank_orders_ties_dense_first(spark):
    d = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "qid long, idx long, dense_score double, rank int")
    s = spark.createDataFrame([(1, 11, 3.0, 1), (1, 12, 2.0, 2)], "qid long, idx long, bm25_score double, rank int")
    rows = {r.idx: r for r in fusion.reciprocal_rank(d, s).collect()}
    assert [rows[i].pos for i in (11, 10, 12)] == [1, 2, 3]
    assert rows[11].score == round(0.6 / 62 + 0.4 / 61, 9)
    alone = fusion.hybrid(d, s.where("false")).collect()
    assert {r.idx: r.score for r in alone} == {10: 0.9, 11: 0.8}


def test_adjust_group_rerank_mmr(spark):
    rows = [
        (1, 0, 0.010, 1, "https://a/narrow/x", "alpha beta", "alpha beta gamma", "alpha beta", [1.0, 0.0]),
        (1, 1, 0.010, 2, "https://a/y", "none", "alpha beta gamma", "alpha", [1.0, 0.0]),
        (1, 2, 0.009, 3, "https://a/y", "none", "alpha beta gamma", "zeta", [0.0, 1.0]),
        (1, 3, 0.008, 4, "https://a/y", "none", "alpha beta gamma", "alpha beta gamma", [0.6, 0.8]),
    ]
    c = candidates(spark, rows)
    adjusted = {r.idx: r.score for r in fusion.adjusted(c, narrow_paths=["/narrow/"], narrow_terms=["nurse"], broad_paths=["/y"]).collect()}
    assert adjusted == pytest.approx({0: 0.010 + 0.003 - 0.004, 1: 0.011, 2: 0.010, 3: 0.009})
    grouped = fusion.grouped_by_url(c).collect()
    assert {r.idx for r in grouped} == {0, 1, 2} and [r.idx for r in sorted(grouped, key=lambda r: r.pos)] == [0, 1, 2]
    blended = fusion.reranked(c, fusion.word_overlap(F.col("query"), F.col("text")), Settings(rerank_cap=3)).collect()
    assert [r.idx for r in sorted(blended, key=lambda r: r.pos)] == [0, 3, 1]
    equal = fusion.reranked(candidates(spark, [(1, k, 0.5, k, "u", "t", "q", "q", [1.0]) for k in range(2)]), fusion.word_overlap(F.col("query"), F.col("text"))).collect()
    assert {r.rerank_score for r in equal} == {round(0.7 + 0.15, 9)}
    picks = fusion.mmr(c, settings=Settings(final_topk=3)).orderBy("pick").collect()
    assert [r.idx for r in picks] == [0, 2, 3]


def test_score_adjust_lowers_narrow_and_raises_broad_addresses(spark, tmp_path):
    """The query's own lists: a guide for one occupation loses 0.004 unless an occupation is asked for, a general page gains
    0.001 once, and places follow the new scores."""
    from lexmill.plans import catalog

    narrow, both = "https://a/Guides-for-Occupations-and-Industries/x", "https://a/guides-for-occupations-and-industries/clothing"
    urls = {0: "https://a/p", 1: narrow, 2: "https://a/Clothing/working-from-home", 3: both, 50: "https://a/q", 4: "https://a/not-guides-for-occupations-and-industries"}
    titles = {0: "alpha beta", 50: "Nurse"}
    docs = [(str(k), titles.get(k, f"t{k}"), u, None, None, None, "x") for k, u in urls.items()]
    spark.createDataFrame(docs, "id string, title string, url string, section_heading string, breadcrumb string, keywords string, text string").write.parquet(str(tmp_path / "docs.parquet"))
    vecs = [(k, str(k), [1.0, k / 100] + [0.0] * 62) for k in urls]
    spark.createDataFrame(vecs, "idx long, id string, vec array<float>").write.parquet(str(tmp_path / "docvecs.parquet"))
    before = {(r.qid, r.idx): r.score for r in catalog.hybrid_search(spark, str(tmp_path)).collect()}
    rows = catalog.score_adjust(spark, str(tmp_path)).collect()
    gain = {(r.qid, r.idx): round(r.score - before[r.qid, r.idx], 6) for r in rows}
    assert gain == {(0, 0): 0.003, (0, 1): -0.004, (0, 2): 0.001, (0, 3): -0.003, (0, 50): 0, (0, 4): 0} | {(50, 0): 0, (50, 1): 0, (50, 2): 0.001, (50, 3): 0.001, (50, 50): 0.001, (50, 4): 0}
    for q in (0, 50):
        mine = sorted((r for r in rows if r.qid == q), key=lambda r: r.pos)
        assert [r.pos for r in mine] == list(range(1, 7)) and [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)


def test_mmr_with_few_candidates_and_missing_vectors(spark):
    c = candidates(spark, [(1, 0, 1.0, 1, "u", "t", "q", "x", None), (1, 1, 1.0, 2, "u", "t", "q", "x", None)])
    assert [r.idx for r in fusion.mmr(c).orderBy("pick").collect()] == [0, 1]


def test_evaluation(spark):
    q = spark.createDataFrame([(1, ["/B"], ["fee", "zz"], "T1", "x"), (2, ["/nope"], [], "T1", "y"), (3, [], ["a"], "T2", "y")], "qid long, fragments array<string>, answer_words array<string>, tier string, category string")
    r = spark.createDataFrame([(1, 1, "https://h/a", "no"), (1, 2, "https://h/b", "The FEE"), (2, 1, "https://h/c", "x")], "qid long, pick int, url string, text string")
    got = {x.qid: x for x in evaluation.ranks(q, r).collect()}
    assert (got[1].rank, got[1].mrr, got[1].kw_recall) == (2, 0.5, 0.5)
    assert (got[2].rank, got[2].hit, got[2].kw_recall) == (None, False, 0.0)
    assert (got[3].rank, got[3].kw_recall) == (1, 0.0)
    m = evaluation.metrics(evaluation.ranks(q, r)).first()
    assert (m.n, m.hits, m.r1, m.r3) == (3, 2, round(1 / 3, 6), round(2 / 3, 6))
    assert evaluation.by_group(evaluation.ranks(q, r)).count() == 1 + 2 + 2


def test_latency_is_the_ranked_value(spark):
    rows = [("a", float(v) / 4, v) for v in range(200)] + [("b", 3.0, 1), ("b", None, 2)]
    got = {r.g: r for r in evaluation.latency(spark.createDataFrame(rows, "g string, v double, i long"), "g", "v", "i").collect()}
    assert got["a"].p95_value == sorted(x[1] for x in rows[:200])[int(200 * 0.95)]
    assert got["b"].p95_value == 3.0 and got["b"].n == 1


def test_latency_of_small_and_wide_values(spark):
    rng = random.Random(4)
    rows = [("small", rng.random(), k) for k in range(700)] + [("wide", 10 ** rng.uniform(-6, 9), k) for k in range(900)] + [("same", 2.5, k) for k in range(50)]
    got = {r.g: r.p95_value for r in evaluation.latency(spark.createDataFrame(rows, "g string, v double, i long"), "g", "v", "i").collect()}
    assert got == {g: sorted(v for h, v, _ in rows if h == g)[int(0.95 * sum(h == g for h, _, _ in rows))] for g in ("small", "wide", "same")}


def test_encoder_seam(spark):
    def make():
        return lambda texts: [[len(t), t.count("a")] for t in texts]

    rows = spark.createDataFrame([(1, "aa"), (2, None), (3, ""), (4, "bbb")], "i long, t string").withColumn("vec", F.lit("clash"))
    got = {r.i: r.vec for r in dense.encoded(rows, "t", make, 2, batch=1).collect()}
    assert got[2] is None and got[3] is None and got[4] == [1.0, 0.0] and got[1] == pytest.approx([0.7071, 0.7071], abs=1e-3)


def test_saved_index_gives_the_same_results(spark, data, tmp_path):
    from lexmill.plans import retrieval

    built = retrieval.build_index(retrieval.corpus(spark, data))
    retrieval.save_index(built, str(tmp_path / "index"))
    found = retrieval.load_index(spark, str(tmp_path / "index"))
    asked = retrieval.known_items(built.docs)
    show = lambda rows: sorted((r.qid, r.pick, r.idx, r.rerank_score) for r in rows.collect())
    first = show(retrieval.retrieve(asked, found))
    assert first and first == show(retrieval.retrieve(asked, built))


def _moved(rows, column):
    """How many shuffles of a plan carry a column."""
    plan = rows._jdf.queryExecution().executedPlan()
    todo, n = [plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan], 0
    while todo:
        node = todo.pop()
        out, below = node.output(), node.children()
        n += node.nodeName() == "Exchange" and any(out.apply(k).name() == column for k in range(out.size()))
        todo += [below.apply(k) for k in range(below.size())]
    return n


@pytest.fixture
def no_broadcasts(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_are_moved_once_and_only_picked_ones_again(spark, data, no_broadcasts):
    """Candidates outnumber documents, so their texts may not be shuffled with them."""
    from lexmill.plans import retrieval

    found, asked = retrieval.prepared_corpus(spark, data)
    rows = retrieval.candidates(asked, found)
    assert _moved(rows, "text") == 1 and rows.where("pair IS NULL").count() == 0
    picked = retrieval.retrieve(asked, found)
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan
    texts = {r.idx: r.text for r in found.docs.select("idx", "text").collect()}
    assert all(r.text == texts[r.idx] for r in picked.select("idx", "text").collect())


def test_compared_searches_run_each_leg_once(spark, data):
    """The hybrid search reads the hits of the other two, which are not searched for again."""
    from lexmill.plans import catalog

    rows = catalog.eval_compare_search(spark, data)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and "FlatMapCoGroupsInPandas" not in plan
    assert {r.search for r in rows.collect()} == {"dense", "bm25", "hybrid"}


def test_citations_retrieve_once(spark, data):
    """Answers and references read the same results, which are not fetched for each."""
    from lexmill.plans import catalog

    assert "parquet" not in catalog.citations(spark, data)._jdf.queryExecution().executedPlan().toString().lower()


def test_retrieval_quality(spark):
    """The gates of the pipeline on known items: hits, mean reciprocal rank, recall in five, and hits by tier."""
    from lexmill.plans import catalog

    rows = catalog._ranked(spark, "/root/testdata/sf0.01")
    whole, tiers = evaluation.metrics(rows).first(), rows.groupBy("tier").agg(F.avg(F.col("hit").cast("int")).alias("h")).collect()
    assert whole.hit_rate >= 0.85 and whole.mrr >= 0.65 and whole.r5 >= 0.85
    assert all(t.h >= 0.75 for t in tiers)


def test_settings_from_the_environment(monkeypatch):
    monkeypatch.setenv("LEXMILL_FINAL_TOPK", "3")
    monkeypatch.setenv("LEXMILL_MMR_LAMBDA", "0.5")
    assert (Settings.from_env().final_topk, Settings.from_env().mmr_lambda, Settings.from_env().rrf_k) == (3, 0.5, 60)


def test_vectors_are_scaled_where_they_are_compared(spark):
    """Given vectors count at length one, as normalized ones do; those without direction are none, nor do they displace others."""
    rng = random.Random(9)
    rows = [(k, [rng.gauss(0, 10 ** rng.uniform(-3, 3)) for _ in range(4)]) for k in range(60)] + [(60, [0.0] * 4), (61, [1.0, None, 2.0, 0.0]), (62, None), (63, [1.0])]
    for kind in ("float", "double"):
        corpus = spark.createDataFrame(rows, f"idx long, vec array<{kind}>")
        whole = dense.normalized(corpus.where("idx < 61"))
        asked = whole.where("idx % 20 = 0").select(F.col("idx").alias("qid"), "vec")
        show = lambda found: sorted(map(tuple, found.collect()))
        first = show(dense.search(asked, corpus, 5, size=4, scale=True))
        assert len(first) == 15 and first == show(dense.search(asked, whole, 5, size=4))


def test_index_moves_each_table_once(spark, data):
    """Few keys repeat, so rows are not sorted before they are moved; postings are counted where their terms are saved."""
    from lexmill.plans import retrieval

    docs = retrieval.corpus(spark, data)
    assert _moved(docs, "text") == 1 and "Sort" not in _before_exchange(docs)
    postings = sparse.index(retrieval.index_text(docs)).postings.sortWithinPartitions("term")
    assert _moved(postings, "term") == 1


def _before_exchange(rows):
    """The operators below the shuffles that read files."""
    plan = rows._jdf.queryExecution().executedPlan()
    todo, found = [(plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan, ())], ""
    while todo:
        node, above = todo.pop()
        name, below = node.nodeName(), node.children()
        above = () if name == "Exchange" else (*above, name)
        if below.size() == 0:
            found += " ".join(above)
        todo += [(below.apply(k), above) for k in range(below.size())]
    return found
