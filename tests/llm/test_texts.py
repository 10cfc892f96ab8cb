import random
import re

import pytest
from pyspark.sql import functions as F

from lexmill.llm import line_repeats, main_body, residue, splitting


def flags(spark, judge, values):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.f for r in df.select("k", judge(F.col("v")).alias("f")).orderBy("k").collect()]


RESIDUE = [
    "Dear {{ customer_name }}, your notice was issued.",
    "Dear {% name %}, hello",
    "The charge comes to ${amountOwed} today.",
    "Send it to [INSERT agent.name] by May.",
    "Prepared by [name - TBC] for you",
    "Prepared by <enter rate> for you",
    "Prepared by <rate goes here> for you",
    "Prepared by %%year%%, @@x@@ and __step_1__",
    "Contact #office-phone# now",
    "Prepared by #REF! for Kel Co.",
    "Contact [object Object] now",
    "Prepared by NaN for us",
    "The limit is $X,XXX for the year",
    "due XX/XX/XXXX at the office",
    "TODO confirm the figure with Kel before release.",
    "DRAFT TEXT - copy to come from Kel, Dun.",
    "Your heading here / your text here for Kel",
    "Guidance first.\n[Editor: replace this paragraph for Kel, see Dun]",
    "Lorem ipsum dolor sit amet, velit elit magna.",
    "Page not found. The address /a/b-c does not exist on this site.",
    "Access denied. You do not have permission to view /a on this server.",
    "Bad gateway. The upstream host did not reply.",
    "This page requires scripts. Turn on JavaScript in your browser settings",
    "Veuillez activer JavaScript pour afficher /a/b",
    "Too many requests from your network. Wait a minute and retry.",
    "Fatal: template abc-def missing, cannot render body",
]
GUIDANCE = [
    "In the formula A = {B + C} x D, the letter B is the amount held.",
    "Use the label [other income] for $10 paid by Kel.",
    "If the portal shows 'Access denied' for Kel, wait and try again.",
    "[Paragraph 12 was repealed on 2024-05-01; see Kel Co. in Dun.]",
    "The message 'page not found' means form BE-1 was withdrawn.",
    "Error 503 on a lodgment receipt tells you that Kel has no record.",
    "Fields marked <optional> on form TC-1 can stay blank.",
    "Write 'null' in the box if Kel paid nothing.",
    "Developers who write JavaScript in Dun can claim $20.",
    "Placeholder shares issued by Kel are taxed.",
    "Template letters from Kel may be reused.",
    "Server maintenance by Kel is deductible.",
    "Use merge fields in letters: ```Dear {{ name }}, ...``` prints the name.",
    "Type the code `${total}` to show the sum.",
    "Draft a deed; 50% of it is yours, #1 on the list, a_b__c.",
    None,
    "",
    "  \n ",
]


def test_residue_and_guidance(spark):
    assert [t for t, f in zip(RESIDUE, flags(spark, residue.text_is_residue, RESIDUE), strict=True) if not f] == []
    assert [t for t, f in zip(GUIDANCE, flags(spark, residue.text_is_residue, GUIDANCE), strict=True) if f] == []


def test_residue_titles(spark):
    bad = [" 404", "Error 404 - Site", "503 Service Temporarily Unavailable", "ACCESS DENIED | SITE NAME", "%title% | Site", "{{page.title}}", "[Insert title here]", "<title> | Site", "Untitled", "null", "xxxx", "Just a moment...", "Page introuvable", "Title TBC - Site", "test test test", "New page 3", "Enable JavaScript to continue"]
    good = ["Form 404 and club memberships in Kel", "Access denied to a refund: your review rights", "Forbidden fruit imports in Kel", "Untitled land and laundry", "Session musicians and tools", "Not found on the register? How to add fees", "Claiming JavaScript courses", "", None, "Moved house? Keep details up to date"]
    assert [t for t, f in zip(bad, flags(spark, residue.title_is_residue, bad), strict=True) if not f] == []
    assert [t for t, f in zip(good, flags(spark, residue.title_is_residue, good), strict=True) if f] == []


def test_residue_rows(spark):
    inv = spark.createDataFrame([(1, 404, "Fees"), (2, None, None), (3, 200, "null"), (None, 500, "x"), (4, 399, "Fees")], "inv_id long, status int, title string")
    ch = spark.createDataFrame([("a", "TODO check this"), ("a", "TODO check this"), ("b", "fine"), (None, "TODO check")], "id string, text string")
    got = sorted(map(tuple, residue.residue_found(inv, ch).collect()))
    assert got == [("chunks", "a"), ("inventory", "1"), ("inventory", "3")]
    assert [r.id for r in residue.without_residue(ch).collect()] == ["b"]


def place_list(spark, text, limit=384):
    df = spark.createDataFrame([("i", text), ("i", text), (None, text), ("n", None)], "id string, text string")
    return sorted(r.word_pos for r in splitting.cut_places(df, limit).collect())


def test_cut_places(spark):
    text = "One two three. Four e.g. five Co. six? Seven (eight) Inc. nine.\nHead line\n\n- item one \n- item two"
    words = [w for w in re.split("[ \n]+", text) if w]
    at = [k for k in place_list(spark, text, 10)]
    assert at == [3, 8, 12, 14, 17] and len(words) == 20


def test_hard_wraps_are_no_places(spark):
    import textwrap

    prose = " ".join(f"Sentence number {k} speaks of the limit that Kel Holdings uses in the year." for k in range(30))
    assert place_list(spark, textwrap.fill(prose, 130), 100) == place_list(spark, prose, 100)


def test_small_and_odd_texts(spark):
    assert place_list(spark, "short text. of nothing", 384) == []
    assert place_list(spark, "", 384) == []
    assert place_list(spark, " ".join(["w"] * 400), 384) == []
    assert place_list(spark, "a no-break space. Kel " * 200, 384)[:1] == [3]


def test_pieces_stay_under_the_limit_and_rebuild_the_text(spark):
    rng = random.Random(3)
    texts = []
    for k in range(12):
        parts = [" ".join(rng.choice(["tax", "form", "e.g.", "Co.", "pay"]) for _ in range(rng.randint(1, 40))) + rng.choice([". ", "\n", "? ", " "]) for _ in range(rng.randint(5, 60))]
        texts.append((f"c{k}", "u" if k < 6 else None, "".join(parts), k, "H"))
    texts += [("long", "u", " ".join(["w"] * 3000), 50, "H"), ("null", "u", None, 51, None), ("huge", "v", "x" * 50_000, 0, "H")]
    df = spark.createDataFrame([*texts, texts[0]], "id string, url string, text string, chunk_index int, section_heading string").withColumn("chunk_total", F.lit(None).cast("int")).withColumn("piece", F.lit("clash"))
    rows = splitting.split_oversized(df, 384, 20).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r)
    for key, url, text, _, heading in texts:
        own = sorted(by[key], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(own[0].pieces)) and all(r.section_heading == heading for r in own)
        if text is None:
            assert own[0].text is None
            continue
        words = [w for w in re.split("[ \n]+", text) if w]
        end = 0
        for k, r in enumerate(own):
            piece = [w for w in re.split("[ \n]+", r.text) if w]
            assert int(len(piece) * 1.3) <= 384
            assert words[r.word_from : r.word_from + len(piece)] == piece
            if k:
                assert end - r.word_from == 20
            end = r.word_from + len(piece)
        assert end == len(words)
    page = sorted((r.chunk_index, r.chunk_total) for r in rows if r.url == "u")
    assert page == [(k, len(page)) for k in range(len(page))]


def test_residue_with_doubled_blanks_and_wraps(spark):
    texts = ["{{ first  name }} may claim the fee.", "It says page  not\nfound. ", "Complete the check below\nto  go on", "Warning:  mysql_query(): failed"]
    both = [(f"{k}{way}", f(t)) for k, t in enumerate(texts) for way, f in (("wide", str), ("plain", lambda t: " ".join(t.split()) + " "))]
    df = spark.createDataFrame([*both, ("none", "Keep the  note.\nThe fee  is paid.")], "id string, text string")
    got = {r.id for r in df.where(residue.text_is_residue(F.col("text"))).collect()}
    assert got == {i for i, _ in both}


def test_residue_is_looked_for_once_and_from_the_start_of_words(spark):
    bad = ["Lorem ipsum", "lorem ipsum dolor", "-page not found. ", "\nwarning:  f(): x", "ErrorException at run(", "null null", "Activer JavaScript"]
    good = ["florem ipsum", "homepage not found. x", "prewarning: f(): x", "annull null", "reactiver JavaScript"]
    assert [t for t, f in zip(bad, flags(spark, residue.text_is_residue, bad), strict=True) if not f] == []
    assert [t for t, f in zip(good, flags(spark, residue.text_is_residue, good), strict=True) if f] == []
    rows = spark.createDataFrame([("a",)], "text string").where(residue.text_is_residue(F.col("text")))
    condition = rows._jdf.queryExecution().analyzed().toString()
    # the blanks before the suspects are told, then one replacement for lines, sentences and the whole
    assert condition.count(r"\s(?:\s+|(?<! ))") == 1


def brute_repeats(rows, least):
    form = lambda s: re.sub("[^a-z0-9]+", "", re.sub("[0-9]+", "0", s.lower()))
    pages = {}
    lines = [(i, n, u.split("/")[2], u, form(x)) for i, u, t in rows if t and u for n, x in enumerate(t.split("\n"), 1)]
    for _, _, s, u, f in lines:
        pages.setdefault((s, f), set()).add(u)
    return {(i, n) for i, n, s, _, f in lines if f and len(pages[s, f]) >= least}


def test_line_repeats_match_brute_force(spark):
    rng = random.Random(5)
    common = [f"Legal notice {k}, © 2024" for k in range(6)] + ["Back to top", "", "..."]
    rows = []
    for k in range(120):
        site = rng.choice(["a.example", "b.example"])
        body = [rng.choice(common) if rng.random() < 0.4 else f"own line {rng.random()}" for _ in range(rng.randint(0, 9))]
        rows.append((f"c{k}", f"https://{site}/p{rng.randint(0, 30)}", "\n".join(body)))
    rows += [("c0", *rows[0][1:]), ("n", None, "Back to top"), ("m", "https://a.example/x", None)]
    df = spark.createDataFrame(rows, "id string, url string, text string").withColumn("page", F.lit(1)).withColumn("item", F.lit(1))
    got = {(r.id, r.line_no) for r in line_repeats.repeated_lines(df, 5).collect()}
    assert got == brute_repeats(rows, 5)
    clean = {r.id: r for r in line_repeats.without_repeated_lines(df, 5).collect()}
    gone = brute_repeats(rows, 5)
    for i, _, t in rows[:120]:
        assert clean[i].text_clean == "\n".join(x for n, x in enumerate(t.split("\n"), 1) if (i, n) not in gone)
    assert clean["m"].text_clean is None


SEQ = "id string, url string, text string"


def brute_closed(rows, least):
    """Closed frequent sequences with gaps: {(site, items): (pages, docs)}."""
    import itertools

    stands = {}
    docs = {(i, u, t) for i, u, t in rows if i and u and t}
    for i, u, t in docs:
        lines = [x for x in t.split("\n") if x]
        own = {c for n in range(1, len(lines) + 1) for c in itertools.combinations(lines, n)}
        for c in own:
            stands.setdefault((u.split("/")[2], c), set()).add((i, u))
    often = {k: v for k, v in stands.items() if len({u for _, u in v}) >= least}
    longer = {(s, c[:j] + c[j + 1 :], len(v)) for (s, c), v in often.items() for j in range(len(c))}
    return {(s, c): (len({u for _, u in v}), len(v)) for (s, c), v in often.items() if (s, c, len(v)) not in longer}


def test_frequent_sequences_grow_from_frequent_prefixes(spark):
    rows = [(f"c{k}", f"https://s.example/{k}", f"own {k}x{chr(97 + k)}\nNotice one\nNotice two\nNotice three") for k in range(6)]
    rows += [("d", "https://s.example/d", "Notice three\nNotice one")]
    found = line_repeats.frequent_sequences(spark.createDataFrame(rows, SEQ), 5).collect()
    assert sorted((r.length, r.pages) for r in found) == [(1, 7), (1, 7), (3, 6)]


def test_frequent_sequences_have_gaps_and_are_closed(spark):
    rng = random.Random(8)
    for letters, most, n in (("abcd", 5, 60), ("abcdefgh", 7, 90), ("ab", 6, 40)):
        rows = [(f"c{k}", f"https://{rng.choice('xy')}.example/{rng.randint(0, 25)}", "\n".join(f"line {rng.choice(letters)}" for _ in range(rng.randint(0, most)))) for k in range(n)]
        rows += [rows[0], ("n", None, "line a"), (None, "https://x.example/1", "line b"), ("m", "https://x.example/2", None)]
        want = brute_closed(rows, 5)
        found = line_repeats.frequent_sequences(spark.createDataFrame(rows, SEQ), 5).collect()
        text = {(i, n): x for i, _, t in rows if i and t for n, x in enumerate(t.split("\n"), 1)}
        got = {(r.site, tuple(text[r.example_id, int(n)] for n in r.example_lines.split(","))): (r.pages, r.docs) for r in found}
        assert len(want) > 10 and len(found) == len(got) and got == want


def test_frequent_sequences_of_any_length(spark):
    rows = [(f"c{k}", f"https://s.example/{k}", "\n".join(f"Notice {chr(97 + j // 26)}{chr(97 + j % 26)}" for j in range(90 if k < 5 else 60)) + f"\nown {chr(97 + k)} line") for k in range(6)]
    found = line_repeats.frequent_sequences(spark.createDataFrame(rows, SEQ), 5).collect()
    assert sorted((r.length, r.pages) for r in found) == [(60, 6), (90, 5)]
    longest = next(r for r in found if r.length == 90)
    assert longest.example_id == "c0" and longest.example_lines == ",".join(map(str, range(1, 91)))
    assert line_repeats.frequent_sequences(spark.createDataFrame([], SEQ), 5).count() == 0


OUTSIDE = ["Back to top", "» Written by Kel Dun.", "Home > Law > Rulings", "You are here: /law/x", "Menu Close Login Register Help", "Privacy | Accessibility | Terms of use | Sitemap", "We use cookies to improve Site. Accept all or manage settings", "Related: Fees in Kel", "Teachers of Dun - exam fees »", "« Silos and graziers", "By Kel Dun, 26 Jan 2022", "Kel Dun | Staff writer | 3 Feb 2021", "Last reviewed 4 Jan 2025", "© 2025 Site", "Information on Site is general and may not suit you", "Call us on 5550 0199 between 8 am and 6 pm", "All guides A-Z | Calculators | Webinars | Site"]
INSIDE = ["Reviewed by Kel Holdings in Dun for form KE-1.", "cookies baked for sale from Kel Co. in Dun, $4", "Choose Menu > Fees > Kel > Dun", "fertiliser | Kel | $20 | 2016-17 | silos | Dun | $3 | 2017-18", "Overview: teachers and fees in Dun", "See s. 24 of the guide for fishers, which covers hives.", "- kilns ($4), sold by Kel Co. of Dun", "Next steps: nurses and scrubs in Kel", "Page not found.", "Written by hand, a receipt counts if the payer signs it and dates it."]


def test_lines_of_page_texts(spark):
    df = spark.createDataFrame([("a", "\n".join(OUTSIDE)), ("b", "\n".join(INSIDE) + "\n\n"), ("c", None), (None, "Back to top")], "id string, text string")
    got = sorted((r.id, r.line_no) for r in main_body.text_lines_outside(df).collect())
    assert got == [("a", k) for k in range(1, len(OUTSIDE) + 1)]
    kept = {r.id: r.text_main for r in main_body.main_text(df).collect()}
    assert kept["a"] == "" and kept["b"] == "\n".join(INSIDE) + "\n\n" and kept["c"] is None


LONG_OUTSIDE = [
    "You are here: /occupations/education-and-training/" + "-".join(["claiming-student-loans-near-holashbry-flats"] * 6),
    "Home > Individuals > Sport and recreation > " + "swimmers and appearance fees " * 9,
    "We use cookies to improve Site. " + "Some of them are needed, and others count visits, pages and clicks. " * 5,
    "© 2025 Site. " + "No part of it may be copied, sold, lent or shown without a written licence. " * 5,
    " | ".join(["Silos and graziers", "Fees of teachers", "Kilns"] * 9),
    "Home Individuals Business Agents Forms Contact " * 7,
    "Related pages: " + " | ".join(["Fees of teachers in Dun"] * 12),
]
LONG_INSIDE = [
    "See also the ruling on fees, " + "which deals with dated invoices, notes and receipts, " * 6,
    "Read more of the invoice than its total, " + "since the date, the payer and the goods all count, " * 6,
    "You are here to claim a fee, so keep the note. " + "Most teachers keep receipts for about 15 months. " * 6,
    "Home > Law. The office treats fees as part of teaching. " + "Keep the dated invoice, and the note of its use. " * 6,
    "Home care workers may claim fees, " + "where the supplier sent a dated invoice, " * 8,
    "Kel | " + "a sentence that runs on without any pipe in it and so is no menu at all " * 5,
]


def test_long_lines_are_judged_by_kind(spark):
    """Over 250 characters a breadcrumb, menu or notice is still none of the main body, and prose still is."""
    assert all(len(" ".join(x.split())) > main_body.LONGEST_NOTICE for x in LONG_OUTSIDE + LONG_INSIDE)
    many = "Home Forms " * 30_000
    df = spark.createDataFrame([("a", "\n".join(LONG_OUTSIDE)), ("b", "\n".join(LONG_INSIDE)), ("m", many + "\n" + "Kel|" * 60_000 + "Kel")], "id string, text string")
    got = sorted((r.id, r.line_no) for r in main_body.text_lines_outside(df).collect())
    assert got == [("a", k) for k in range(1, len(LONG_OUTSIDE) + 1)] + [("m", 1), ("m", 2)]
    prose = "The office treats fees as part of teaching, where the supplier sent a dated invoice, and the use can be shown."
    page = "<body><div><h1>Fees</h1>\n" + "".join(f"<p>{x}</p>\n" for x in [prose, LONG_OUTSIDE[0], prose, LONG_OUTSIDE[2], LONG_INSIDE[0]]) + "</div></body>"
    assert main_body.lines_outside_main(page) == [3, 5]


PAGE = """<!DOCTYPE html>
<html><head><title>Not visible</title><style>p{x:1}</style></head>
<body>
<script>var a = 1;</script>
<a class="skip" href="#c">Skip to content</a>
<div class="q1">
<li><a href="/a">Home page</a></li>
<li><a href="/b">Fees of teachers in Dun</a></li>
</div>
<DIV>
<H1>Fees, and how to claim them</H1>
<P>The office treats fees as part of teaching, where the supplier sent a dated invoice, and the use can be shown.
<P>Most teachers keep receipts for about 15 months, after that, the deduction is lost if the note is missing.</P>
<div class="inline-promo">
<p>Sponsored by Kel Holdings</p>
</div>
<ul>
<li>Form KE-1 - kept by Kel Trust <a href="/f">PDF</a></li>
</ul>
</DIV>
<div class="q2"><p>We use cookies, see settings</p>
<button>OK</button></div>
<footer><p>© 2025 Site</p>
</footer>
<noscript>Scripts are off.</noscript>
</body></html>"""


def test_lines_of_saved_pages(spark):
    assert main_body.lines_outside_main(PAGE) == [5, 7, 8, 15, 21, 22, 23]
    assert main_body.lines_outside_main("") == [] and main_body.lines_outside_main(None) == []
    df = spark.createDataFrame([("p", PAGE), ("p", PAGE), ("n", None), (None, PAGE), ("t", "plain words only")], "filename string, html string")
    got = sorted((r.key, r.line_no) for r in main_body.page_lines_outside(df).collect())
    assert got == [("p", k) for k in (5, 7, 8, 15, 21, 22, 23)]


def test_main_text_of_saved_pages(spark, data):
    from lexmill.llm import catalog

    want = [
        "Fees, and how to claim them",
        "The office treats fees as part of teaching, where the supplier sent a dated invoice, and the use can be shown.",
        "Most teachers keep receipts for about 15 months, after that, the deduction is lost if the note is missing.",
        "Form KE-1 - kept by Kel Trust PDF",
    ]
    assert main_body.main_text_of(PAGE).split("\n") == want
    # blocks on one line are lines of their own, inline marks are not, and wrapped lines stay as they are
    one = "<body><div><h1>Fees</h1><p>Keep the <b>dat</b>ed <i>invoice</i>, the note and the receipt of it, always.</p><p>Then claim,\nin time, what was paid.</p></div><footer><p>© 2025 Site</p></footer></body>"
    assert main_body.main_text_of(one) == "Fees\nKeep the dated invoice, the note and the receipt of it, always.\nThen claim,\nin time, what was paid."
    assert main_body.main_text_of(None) is None and main_body.main_text_of("") == ""
    df = spark.createDataFrame([("p", PAGE), ("p", PAGE), ("n", None), (None, PAGE)], "filename string, html string")
    assert sorted((r.key, r.text_main) for r in main_body.page_main_text(df).collect()) == [("n", None), ("p", "\n".join(want))]
    rows = catalog.p6_text(spark, data)
    keys = {(r.src_table, r.rec_key) for r in rows.select("src_table", "rec_key").collect()}
    pages = {r.filename for r in spark.read.parquet(f"{data}/rawhtml.parquet").select("filename").collect()} - {None}
    assert rows.columns == ["src_table", "rec_key", "text_main"]
    assert {k for s, k in keys if s == "rawhtml"} == pages and any(s == "chunks" for s, _ in keys)


@pytest.mark.parametrize("html", ["<p>", "</p></div>", "<ul><li>a<li>b", "<table><tr><td>x", "<!-- only a comment -->", "<p" * 50])
def test_broken_markup_does_not_fail(html):
    assert isinstance(main_body.lines_outside_main(html), list)


def test_semicolons_are_no_places(spark):
    text = "interest starts from the day after; Short absences are ignored; • cookies are sold. The end"
    assert place_list(spark, text, 10) == [14]


def test_narrow_hard_wraps_are_told_by_their_own_width(spark):
    import textwrap

    prose = " ".join(f"Sentence number {k} speaks of the limit that Kel Holdings uses in the year." for k in range(30))
    for width in (60, 76, 95):
        assert place_list(spark, textwrap.fill(prose, width), 100) == place_list(spark, prose, 100)


def test_long_words_are_one_word_and_may_be_cut(spark):
    words = ["One two three four."] * 3 + ["x" * 6000 + " ends here."] + ["Five six seven."] * 4
    text = " ".join(words)
    short = " ".join(w.replace("x" * 6000, "x") for w in words)
    assert place_list(spark, text, 10) == place_list(spark, short, 10) != []
    df = spark.createDataFrame([("i", "u", text, 0, 1)], "id string, url string, text string, chunk_index int, chunk_total int")
    rows = sorted(splitting.split_oversized(df, 4, 0, word_chars=1000).collect(), key=lambda r: r.piece)
    assert "".join(r.text for r in rows).replace(" ", "") == text.replace(" ", "")
    assert max(len(r.text) for r in rows) <= 3 * 1000 + 2


def test_template_expressions_and_unknown_filler(spark):
    bad = [
        "Dear {{ customer.name | upper }}, hello",
        "Dear {{ first name of customer }}, hello",
        "Dear {{ user['name'] | default: 'friend' }}, hello",
        "{% if x == 1 %} Pay the fee.",
        "{%- for item in cart.items -%} Pay the fee.",
        "Total <%= order.total * 2 %> is due",
        "Total #{order_total} is due",
        "Dear {{" + "very_long_field_name_" * 10 + "}}, hello",
        "Guidance first.\nMorbi pretium egestas lectus viverra fermentum. More guidance for you.",
        "The server said: unable to render the template for this page.",
    ]
    good = ["In the set {B + C, D} the letters are sums.", "Radio, video and piano media data are for sale.", "Agenda: Santa Monica area era", "A gorilla, a panda and a koala sit in a villa."]
    assert [t for t, f in zip(bad, flags(spark, residue.text_is_residue, bad), strict=True) if not f] == []
    assert [t for t, f in zip(good, flags(spark, residue.text_is_residue, good), strict=True) if f] == []
    spaced = ["Page  not  found. Try again.", "Upstream  host did not reply", "The service is  unavailable", "Access\n denied. Go back."]
    assert flags(spark, residue.text_is_residue, spaced) == [True] * 4


def test_densities_measured_on_saved_pages(spark):
    """Wordings that no cue knows are learnt from where saved pages have them; prose with such a beginning stays."""
    prose = "The office treats fees as part of teaching, where the supplier sent a dated invoice, and the use can be shown."
    page = "<body><div><a href='/'>Get our weekly digest by mail</a></div>\n<article><h1>Fees</h1>\n<p>{0} {0}</p>\n<p>{0} {0}</p>\n<p>Written records count, {0}</p></article>\n<footer><p>Grab the app for your phone</p></footer></body>"
    pages = spark.createDataFrame([(f"p{k}", page.format(prose)) for k in range(120)] + [(f"e{k}", "<body><p>Page not there. Go back home.</p></body>") for k in range(60)] + [("n", None), (None, page)], "filename string, html string")
    seen = main_body.page_lines(pages)
    known = main_body.measured_densities(seen)
    text = "\n".join(["Get our weekly digest by mail", prose, "Grab the app for your phone", "", "Written records count, so keep them.", "Page not there. Go back home.", "Grab the app.", "Grab the app for your phone, where the office lists fees, rates, forms, dates, agents, payers, notes, years, books, sums, claims, places and names, and keep all of it, since each of them counts, even if paid late."])
    chunks = spark.createDataFrame([("a", text), ("n", None), (None, text)], "id string, text string")
    assert sorted((r.id, r.line_no) for r in main_body.text_lines_outside(chunks, densities=known).collect()) == [("a", 1), ("a", 3)]
    kept = {r.id: r.text_main for r in main_body.main_text(chunks, densities=known).collect()}
    assert kept["a"].split("\n") == [x for k, x in enumerate(text.split("\n"), 1) if k not in (1, 3)] and kept["n"] is None and kept[None] == text
    assert main_body.text_lines_outside(chunks).count() == 0
    assert main_body.measured_densities(seen.limit(0)).count() == 0
