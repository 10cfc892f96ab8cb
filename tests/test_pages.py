from pyspark.sql import functions as F

from lexmill.config import Settings
from lexmill.operators import chunking, html, inventory, keywords

CARD = '<div class="x-card__title-y"><a>{}</a></div>'


def page(body):
    return f"<html><head><title>T</title><style>.card__title{{}}</style></head><body>{body}</body></html>"


def saved(spark, *bodies):
    return spark.createDataFrame([(str(k), b) for k, b in enumerate(bodies)], "filename string, html string")


def hubs_of(spark, *bodies, **how):
    return [(r.is_hub, r.card_headings) for r in html.hubs(saved(spark, *bodies), **how).orderBy("key").collect()]


def sections_of(spark, body):
    return [(r.heading, r.content) for r in html.sections(saved(spark, body)).orderBy("pos").collect()]


def test_hub_needs_three_cards(spark):
    three = page("".join(CARD.format(x) for x in ("Income", "Income", "y" * 150)))
    assert hubs_of(spark, three, page(CARD.format("a") * 2), page("no cards")) == [(True, ["Income"]), (False, []), (False, [])]


def test_hub_by_shape(spark):
    linked = page("<main>" + "".join(f"<h3><a href='/{k}'>Head {k}</a></h3>" for k in range(3)) + "</main>")
    card = "<div class='x-Card'><h1>Not this</h1><span class='big-title'>Card {}</span><h2>nor this</h2></div>"
    cards = page("<main>" + "".join(card.format(k) for k in range(3)) + "</main><div class='card'><h2>outside main</h2></div>")
    boxes = page("<main><section><h2>One</h2><h3>Two</h3><h3>Three</h3><p>text</p>" + "<a>x</a>" * 4 + "</section></main>")
    wordy = page("<main><section><h2>One</h2><h3>Two</h3><h3>Three</h3><p>a</p><p>b</p>" + "<a>x</a>" * 4 + "</section></main>")
    # two headed links are too few for the third test, but the page is hardly more than links
    bare = page("<main>" + "".join(f"<h4><a href='/{k}'>Link {k}</a></h4>" for k in range(3)) + "<a href='/x'>x</a>" * 4 + "</main>")
    long = page("<main>" + "".join(f"<h4><a href='/{k}'>Link {k}</a></h4>" for k in range(3)) + "<a href='/x'>x</a>" * 4 + "y" * 2000 + "</main>")
    got = hubs_of(spark, linked, cards, boxes, wordy, bare, long, by_shape=True)
    assert got == [(True, ["Head 0", "Head 1", "Head 2"]), (True, ["Card 0", "Card 1", "Card 2"]), (True, ["One", "Two", "Three"]), (False, []), (True, ["Link 0", "Link 1", "Link 2"]), (False, [])]


def test_sections(spark):
    body = (
        "<nav><p>not this menu text at all, never</p></nav><main><h1>One</h1><p>" + "first words " * 6 + "</p><h2>On this page</h2>"
        "<p>" + "still first " * 3 + "</p><h2>Two</h2><ul><li><p>" + "nested item " * 6 + "</p></li></ul><p>short</p></main>"
    )
    found = sections_of(spark, page(body))
    assert [h for h, _ in found] == ["One", "Two"]
    assert "still first" in found[0][1] and "menu" not in found[0][1]
    assert found[1][1].count("nested item") == 12 and "short" not in found[1][1]


def test_noise_inside_the_content(spark):
    words = "words of the first part " * 4
    body = f"<main><h2>One <span class='share-box'>Share</span></h2><p>{words}<script>var x;</script></p><div class='Side-Menu'><h2>Menu</h2><p>{words}</p></div><table><tr><td>{words}<th>cell\u200b \u00a0ｗｉｄｅ one</table></main>"
    assert sections_of(spark, page(body)) == [("One", "\n".join([words.strip(), words + "cell wide one", "cell wide one"]))]


def test_sections_fall_back_on_the_whole_text(spark):
    found = sections_of(spark, page("<div>" + "plain words here " * 5 + "</div>"))
    assert len(found) == 1 and found[0][0] == ""


def test_one_outline_serves_all(spark):
    once = html.outlines(saved(spark, page("<main><h2>Fees</h2><p>" + "words enough " * 9 + "</p><a href='/x'>x</a></main>")))
    assert html.sections(once).first().heading == "Fees"
    assert html.links(once).first().href == "/x"
    assert html.hubs(once, by_shape=True).first().is_hub is False


def test_child_links(spark):
    found = spark.createDataFrame([("p", k, h) for k, h in enumerate(["b?x=1", "/tax/a", "http://h.example/tax/b", "mailto:x@y", "https://other.example/tax/c", "/law/d", "/tax/share/e", "/tax/f"])] + [("q", 0, "/tax/a")], "key string, pos int, href string")
    bases = spark.createDataFrame([("p", "https://h.example/tax/start"), ("q", None)], "key string, url string")
    got = [(r.pos, r.link) for r in html.child_links(found, bases, "/tax").orderBy("pos").collect()]
    assert got == [(0, "https://h.example/tax/b"), (1, "https://h.example/tax/a"), (7, "https://h.example/tax/f")]
    assert [r.pos for r in html.child_links(found, bases, "/tax", most=2).orderBy("pos").collect()] == [0, 1]
    assert [r.link for r in html.child_links(found, bases, host="other.example").collect()] == ["https://other.example/tax/c"]


def test_titles(spark):
    given = ["<title lang=en>Fees &amp;\n  costs &#8211; caf&eacute;</title>", "<p>none", "<TITLE>a &lt;b&gt;</TITLE><title>second</title>"]
    assert [r.t for r in saved(spark, *given).select(html.title(F.col("html")).alias("t")).collect()] == ["Fees & costs – café", "", "a <b>"]


def test_pages_with_nulls_give_no_rows(spark):
    df = spark.createDataFrame([("a", None), (None, "<p>x</p>"), ("b", "")], "filename string, html string")
    assert html.sections(df).count() == 0
    assert html.links(df).count() == 0
    assert html.hubs(df).collect()[0].is_hub is False


def fold_merge(sections, limit):
    size = lambda t: int(len(t.split()) * 1.3)
    out, head, text, n = [], "", "", 0
    for h, c in sections:
        if n + size(c) <= limit:
            head, text, n = head or h, (text + "\n\n" if text else "") + c, n + size(c)
        else:
            if text:
                out.append((head, text))
            head, text, n = h, c, size(c)
    return [*out, (head, text)] if text else out


def test_merge_and_pack(spark):
    words = lambda n: " ".join(["w"] * n)
    sections = [("", words(50)), ("A", words(100)), ("B", words(200)), ("C", words(10)), ("D", words(400))]
    df = spark.createDataFrame([([(h, c) for h, c in sections],)], "s array<struct<heading:string,content:string>>")
    got = df.select(chunking.merged(F.col("s"), 384).alias("m")).first().m
    assert [tuple(x) for x in got] == fold_merge(sections, 384)
    sentences = " ".join(f"{words(99)} end{k}." for k in range(7)) + " tail."
    pieces = spark.createDataFrame([(sentences,)], "t string").select(chunking.packed(F.col("t"), 384, 60).alias("p")).first().p
    assert [p.count("end") for p in pieces] == [2, 2, 2, 1]
    one = words(500) + "."
    whole = spark.createDataFrame([(one,)], "t string").select(chunking.packed(F.col("t"), 384, 60).alias("p")).first().p
    assert whole == [one]


def test_page_chunks(spark):
    sections = spark.createDataFrame([("f", 1, "B", "b " * 200), ("f", 0, "A", "a " * 200)], "key string, pos int, heading string, content string")
    pages = spark.createDataFrame([("f", "https://h.example/x/y-z", "Title | Site")], "key string, url string, title string")
    rows = chunking.page_chunks(sections, pages, settings=Settings()).orderBy("chunk_index").collect()
    assert [r.section_heading for r in rows] == ["A", "B"]
    assert rows[0].heading_prefix == "Title — A" and rows[0].chunk_total == 2 and rows[0].breadcrumb == "X > Y Z"


def test_hub_keywords(spark):
    pages = spark.createDataFrame([("https://h.example/tax/super-funds/fees",), ("https://h.example/other",), (None,)], "url string")
    hubs = spark.createDataFrame(
        [("https://h.example/tax/super-funds", ["Fees and charges", "Unrelated"]), ("https://h.example/tax", ["Super for you", "Cars"]), ("https://h.example/none", None)],
        "url string, card_headings array<string>",
    )
    got = {r.url: r.keywords for r in keywords.hub_keywords(pages, hubs).collect()}
    assert got["https://h.example/tax/super-funds/fees"] == ["fees", "charges", "super", "tax", "funds"]
    assert got["https://h.example/other"] == ["other"]
    enough = {r.url: r.keywords for r in keywords.hub_keywords(pages, hubs, enough=2).collect()}
    assert enough["https://h.example/tax/super-funds/fees"] == ["fees", "charges", "tax", "super", "funds"]


def test_inherited_keywords(spark):
    links = spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "d"), ("c", 0, "d"), ("d", 0, "a")], "parent string, pos int, child string")
    words = spark.createDataFrame([("a", ["wa"]), ("b", ["wb"]), ("d", ["wd"])], "url string, words array<string>")
    got = {r.url: (r.depth, r.keywords) for r in keywords.inherited_keywords(links, spark.createDataFrame([("a",)], "url string"), words).collect()}
    assert got == {"a": (0, ["wa"]), "b": (1, ["wa", "wb"]), "c": (1, ["wa"]), "d": (2, ["wa", "wb", "wd"])}


def test_inherited_keywords_at_any_depth(spark):
    links = spark.createDataFrame([(f"n{k}", 0, f"n{k + 1}") for k in range(11)], "parent string, pos int, child string")
    words = spark.createDataFrame([("n0", ["w0"]), ("n11", ["w11"])], "url string, words array<string>")
    got = {r.url: (r.depth, r.keywords) for r in keywords.inherited_keywords(links, spark.createDataFrame([("n0",)], "url string"), words).collect()}
    assert len(got) == 12 and got["n11"] == (11, ["w0", "w11"])


def test_inherited_keywords_of_saved_pages(spark, tmp_path):
    from lexmill.plans import catalog

    at = "https://h.example/"
    page = lambda *to: "<body><main>" + "".join(f'<a href="/{x}">x</a>' for x in to) + "</main></body>"
    # a chain longer than eight links, and a ring that nothing leads into
    chain = [f"tax/step{k}" for k in range(11)]
    tree = {a: [b] for a, b in zip(chain, chain[1:], strict=False)} | {chain[-1]: [], "ring/one": ["ring/two"], "ring/two": ["ring/one", "ring/out"]}
    rows = [(k, at + u, 200, "T", f"{k}.html") for k, u in enumerate(tree)]
    spark.createDataFrame(rows, "inv_id long, url string, status int, title string, filename string").write.parquet(str(tmp_path / "inventory.parquet"))
    spark.createDataFrame([(f"{k}.html", page(*to)) for k, to in enumerate(tree.values())], "filename string, html string").write.parquet(str(tmp_path / "rawhtml.parquet"))
    got = {r.url: (r.depth, r.keywords) for r in catalog.QUERIES["inherited_keywords"](spark, str(tmp_path)).collect()}
    assert set(got) == {at + u for u in [*tree, "ring/out"]}
    assert got[at + chain[10]] == (10, "tax " + " ".join(f"step{k}" for k in range(11)))
    assert got[at + "ring/one"] == (0, "ring one") and got[at + "ring/out"] == (1, "ring two out")


def test_only_first_leaves_count_toward_the_branch_cap(spark):
    from lexmill.operators import inventory

    kinds = ["hub", "fetch-error", "leaf", "leaf-dup", "leaf", "leaf-empty", "leaf"]
    rows = spark.createDataFrame([(k, f"https://h.example/a/b/c/{k}", t) for k, t in enumerate(kinds)], "inv_id int, url string, type string")
    got = sorted(r.inv_id for r in inventory.capped_by_branch(rows, 2, "inv_id", counts=F.col("type") == "leaf").collect())
    assert got == [0, 1, 2, 3, 4]
    assert sorted(r.inv_id for r in inventory.capped_by_branch(rows, 2, "inv_id").collect()) == [0, 1]


def test_inventory_merge(spark):
    kind = "inv_id long, url string, status int, title string, filename string, size long, fetched_at timestamp"
    stamp = lambda k: __import__("datetime").datetime(2024, 1, k)
    old = spark.createDataFrame([(1, "u", 0, None, "", None, stamp(1)), (2, "v", 200, "V", "v.html", 5, stamp(1)), (3, None, 0, None, "", None, stamp(1))], kind)
    new = spark.createDataFrame([(4, "u", 200, "first", "u1.html", 1, stamp(2)), (5, "u", 200, "second", "u2.html", 2, stamp(3)), (6, "v", 500, None, "", None, stamp(3))], kind)
    got = {r.inv_id: (r.status, r.filename) for r in inventory.merged(old, new).collect()}
    assert got == {1: (200, "u2.html"), 2: (200, "v.html"), 3: (0, "")}


def test_added_files_and_content_dedup(spark):
    a = spark.createDataFrame([("x", 1)], "filename string, n int")
    b = spark.createDataFrame([("x", 2), ("y", 3)], "filename string, n int")
    assert sorted(map(tuple, inventory.added_files(a, b).collect())) == [("x", 1), ("y", 3)]
    t = spark.createDataFrame([("b", "same"), ("a", "same"), ("c", None)], "id string, text string")
    assert [r.id for r in inventory.first_of_content(t, "text", "id").collect()] == ["a"]


def test_deeply_nested_pages_are_read(spark):
    deep = "<p>" * 2000 + "words enough to make up one whole section of this page, and some more"
    assert sections_of(spark, deep)[0][1].startswith("words enough")
    assert hubs_of(spark, deep, by_shape=True) == [(False, [])]
