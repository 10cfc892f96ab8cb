from pyspark.sql import functions as F

from lexmill.functions import text as X
from lexmill.functions import urls as U
from lexmill.functions import vectors as V
from lexmill.operators import answers


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first().y


def test_https_drops_query_fragment_and_parameters(spark):
    assert one(spark, U.to_https, "http://a.example:8080/b/c;p=1?q=2#f") == "https://a.example:8080/b/c"
    assert one(spark, U.to_https, None) is None


def test_breadcrumb_upper_cases_after_any_other_character(spark):
    assert one(spark, U.breadcrumb, "https://a.example/foo2bar/it's-mine/") == "Foo2Bar > It'S Mine"
    assert one(spark, U.breadcrumb, "https://a.example/") == ""


def test_skipped_links(spark):
    for url in ("mailto:a@b", "TEL:1", "https://a/share/x", "https://a/x?page=2", "https://a/search?q"):
        assert one(spark, U.should_skip, url)
    assert not one(spark, U.should_skip, "https://a/x?q=1")


def test_file_names(spark):
    assert one(spark, U.filename, "https://a.example/b/c/") == "b__c.html"
    assert one(spark, U.filename, "https://a.example") == "index.html"
    long = one(spark, U.filename, "https://a.example/" + "x" * 300)
    assert len(long) == 190 + 2 + 8 + 5


def test_branch_and_ancestors(spark):
    assert one(spark, U.branch_key, "https://a.example/b/c/d/e") == "/b/c/d"
    assert one(spark, U.branch_key, "https://a.example/b") == "/b"
    found = one(spark, U.ancestors, "https://a.example/b/c")
    assert [(a.depth, a.url, a.child) for a in found] == [(2, "https://a.example/b", "c"), (1, "https://a.example", "b")]


def test_url_join(spark):
    df = spark.createDataFrame([("https://a.example/b/c", "../d"), (None, "x"), ("https://a.example", None)], "b string, h string")
    assert [r[0] for r in df.select(U.url_join("b", "h")).collect()] == ["https://a.example/d", None, None]


def test_clean_text(spark):
    got = one(spark, X.clean_text, " Skip to main contentA b​c ｄ QC 123\n\n\n\nLast updated 1 July 2024 end ")
    assert got == "A bc d \n\n end"


def test_counts_and_keywords(spark):
    assert one(spark, X.token_count, "a b c d") == 5
    assert one(spark, X.token_count, "") == 0
    assert one(spark, X.keywords, "The Self-education of ENGINEERS, x 42") == ["self-education", "engineers", "42"]


def test_keyword_string_keeps_first_occurrences(spark):
    df = spark.createDataFrame([(["b", "a", "b"], "What a-b to claim"), (None, None)], "k array<string>, h string")
    assert [r[0] for r in df.select(X.keyword_string(F.col("k"), F.col("h"))).collect()] == ["b a claim", ""]


def test_chunk_ids_do_not_truncate(spark):
    df = spark.createDataFrame([("u", 0), ("u", 1233)], "u string, i int")
    ids = [r[0] for r in df.select(X.chunk_id(F.col("u"), F.col("i"))).collect()]
    assert ids[0].endswith("_001") and ids[1].endswith("_1234")


def test_answers(spark):
    assert one(spark, X.clean_answer, "assistant:  Yes.\n\n\n\nNo. ") == "Yes.\n\nNo."
    assert one(spark, X.clean_answer, None) == ""
    assert one(spark, X.citations, "as [1] and [12], not [x]") == [1, 12]
    assert one(spark, lambda c: X.with_disclaimer(c, "N"), "Ask a Professional") == "Ask a Professional"
    assert one(spark, lambda c: X.with_disclaimer(c, "N"), "Yes") == "Yes\n\nN"


def test_understanding_falls_back_field_by_field(spark):
    fenced = '```json\n{"intent": "general_chat", "search_queries": ["a", "b", "c", "d"]}\n```'
    df = spark.createDataFrame([(fenced,), ("no json",), ('{"search_queries": []}',), (None,)], "raw string")
    got = [r.u for r in df.select(answers.understood(F.col("raw"), F.lit("q")).alias("u")).collect()]
    assert (got[0].intent, got[0].understood_need, got[0].search_queries) == ("general_chat", "q", ["a", "b", "c"])
    assert all(g.search_queries == ["q"] and g.intent == "question" for g in got[1:])


def test_history(spark):
    rows = [(1, k, "user" if k % 2 else "system", f"m{k}") for k in range(1, 9)] + [(2, 1, "user", "alone")]
    got = answers.history(spark.createDataFrame(rows, "conv int, turn int, role string, content string")).collect()
    assert len(got) == 1
    assert got[0].history == "Recent conversation:\nUser: m3\nAssistant: m4\nUser: m5\nAssistant: m6\nUser: m7\nAssistant: m8\n\n"


def test_vectors(spark):
    assert one(spark, V.unit, [3.0, 4.0], "array<float>") == [0.6, 0.8]
    assert one(spark, V.unit, [0.0, 0.0], "array<float>") is None
