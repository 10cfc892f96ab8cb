from lexmill.sources.tables import table
from lexmill.streaming import rechunk


def test_stream_prepares_what_a_batch_prepares(spark, data, tmp_path):
    from lexmill.operators import docs

    source = str(tmp_path / "in")
    table(spark, data, "chunks").repartition(3).write.parquet(source)
    run = rechunk.prepare_stream(spark, source, str(tmp_path / "out"), str(tmp_path / "state"), lateness="4000 days", files_per_batch=1)
    assert run.awaitTermination(120)
    got = {r.id for r in spark.read.parquet(str(tmp_path / "out")).select("id").collect()}
    want = {r.id for r in docs.prepared(table(spark, data, "chunks")).select("id").collect()}
    assert got == want


def test_stream_keeps_late_chunks_and_drops_repeats(spark, tmp_path):
    """Files out of time order, one a batch, with the default lateness; a second run takes only what is new."""
    import os

    from lexmill.operators import docs

    kind = "id string, title string, url string, section_heading string, breadcrumb string, keywords array<string>, heading_prefix string, text string, chunk_index int, chunk_total int, crawled_at timestamp"
    text = "The office treats fees as part of teaching, where the supplier sent a dated invoice. " * 5
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def deliver(name, *chunks):
        from datetime import datetime

        made = [(i, "t", "https://a.example/" + i, "h", "b", ["k"], "p", text, 0, 1, when and datetime.fromisoformat(when)) for i, when in chunks]
        spark.createDataFrame(made, kind).coalesce(1).write.mode("append").parquet(source)
        for file in os.listdir(source):
            # the order of batches is that of the files' times
            if file.endswith(".parquet") and file not in seen:
                seen.append(file)
                os.utime(f"{source}/{file}", (1_700_000_000 + 100 * len(seen),) * 2)

    def run():
        assert rechunk.prepare_stream(spark, source, out, state, files_per_batch=1).awaitTermination(120)
        return sorted(r.id for r in spark.read.parquet(out).select("id").collect())

    seen = []
    deliver("new", ("a", "2025-05-01"), ("b", "2025-05-02"), ("b", "2025-05-02"))
    deliver("old", ("c", "2024-01-01"), ("a", "2025-05-01"))
    deliver("older", ("d", "2023-06-01"), ("e", None), ("c", "2025-05-03"))
    assert docs.prepared(spark.read.parquet(source)).count() == 8
    assert run() == ["a", "b", "c", "d", "e"]
    deliver("later", ("f", "2022-01-01"), ("d", "2023-06-01"))
    assert run() == ["a", "b", "c", "d", "e", "f"]


def test_arrivals(spark, data):
    chunks = table(spark, data, "chunks")
    got = rechunk.arrivals(chunks).agg({"chunks": "sum"}).first()[0]
    assert got == chunks.where("crawled_at IS NOT NULL").count()


def test_sources(spark, tmp_path):
    from lexmill.sources import tables as S

    (tmp_path / "i.csv").write_text('url,status,title,filename,size\nhttps://a/x,200,"T, t",x.html,3\nhttps://a/y,0,,,\n')
    assert [r.filename for r in S.read_inventory_csv(spark, str(tmp_path / "i.csv")).collect()] == ["x.html"]
    (tmp_path / "c.jsonl").write_text('{"id":"1","text":"a"}\n\n{"id":"2"}\n')
    assert S.read_chunks_jsonl(spark, str(tmp_path / "c.jsonl")).where("id IS NOT NULL").count() == 2
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "p.html").write_bytes(b"<p>\xff</p>")
    assert S.read_html_folder(spark, str(tmp_path / "h")).first().filename == "p.html"
    (tmp_path / "s.xml").write_text("<urlset><url><loc>http://h.example/b</loc></url><url><loc>https://h.example/a</loc></url><url><loc>https://other/a</loc></url></urlset>")
    assert [r.url for r in S.read_sitemap(spark, str(tmp_path / "s.xml"), "h.example").collect()] == ["https://h.example/a", "https://h.example/b"]
    S.write_jsonl(spark.createDataFrame([("1", None)], "id string, text string"), str(tmp_path / "o"))
    assert spark.read.json(str(tmp_path / "o")).columns == ["id", "text"]
    rows = spark.createDataFrame([("u", 200, "t", "f", 1)], S.INVENTORY_SCHEMA)
    S.append_csv(rows, str(tmp_path / "a"))
    S.append_csv(rows, str(tmp_path / "a"))
    assert spark.read.csv(str(tmp_path / "a"), header=True).count() == 2


def test_documents_questions_reports_and_seeds(spark, tmp_path):
    import json

    from lexmill.operators import evaluation
    from lexmill.sources import tables as S

    (tmp_path / "d.jsonl").write_text('{"id":"1","text":"a","embed_text":""}\n\n{"id":"2","text":""}\n{"id":"3","text":"b","embed_text":"e","title":"T"}\n{"id":"4"}\n')
    docs = {r.id: r for r in S.read_docs_jsonl(spark, str(tmp_path / "d.jsonl")).collect()}
    assert set(docs) == {"1", "3"} and docs["1"].embed_text == "a" and docs["1"].title == "" and docs["3"].embed_text == "e"
    (tmp_path / "q.json").write_text(json.dumps([{"id": 1, "question": "How?", "tier": "T1", "category": "x", "expected_url_contains": ["/b"], "expected_answer_contains": ["fee"]}, {"id": 2, "question": "Who?", "tier": "T2", "expected_url_contains": ["/z"]}]))
    asked = S.read_questions(spark, str(tmp_path / "q.json"))
    results = spark.createDataFrame([(1, 1, "https://h/b", "The fee"), (2, 1, "https://h/a", "x")], "qid long, pick int, url string, text string")
    compared = spark.createDataFrame([("dense", 1, 2, 0.5)], "search string, hits long, total long, mrr double")
    S.write_report(evaluation.report(evaluation.ranks(asked, results), compared), str(tmp_path / "r"))
    got = spark.read.json(str(tmp_path / "r")).first().asDict(recursive=True)
    assert (got["n"], got["retrieval"]["hit_rate"], got["retrieval"]["mrr"], got["retrieval"]["kw"]) == (2, 0.5, 0.5, 0.5)
    assert got["tiers"] == {"T1": {"hit": 1.0, "mrr": 1.0}, "T2": {"hit": 0.0, "mrr": 0.0}}
    assert got["search_comparison"]["dense"]["hits"] == 1 and [r["rank"] for r in got["results"]] == [1, None]
    pages = spark.createDataFrame([("https://h/tax/a",), ("https://h/tax/private/b",), ("https://h/law",), ("https://h/tax/a",)], "url string")
    rules = spark.createDataFrame([("/tax/private",), ("",), (None,)], "path string")
    assert [r.url for r in S.seeds(pages, "/tax", rules).collect()] == ["https://h/tax/a"]
    assert S.seeds(pages, "/tax").count() == 2
