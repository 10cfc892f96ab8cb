"""Reading saved pages: outlines, sections, hub cards, links and titles.

A page is parsed once, inside Arrow batches, into its outline: the elements in document order as a flat array, each with
the place of its last descendant and the range of text pieces inside it, and the text pieces. What lies inside an
element is then a slice of either array, and the content root, noise, sections, hub tests and links are expressions over
the outline, without further Python and without a shuffle. ``sections``, ``hubs`` and ``links`` take pages or outlines,
so that a caller who wants several of them parses once.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.config import NOISE_HEADINGS
from lexmill.functions import text as X
from lexmill.functions import urls as U

# Tags and class names that results depend on.
EMPTY_TAGS = "area base br col embed hr img input link meta param source track wbr".split()
HEADING_TAGS = "h1 h2 h3 h4".split()
PART_TAGS = "p li td th dt dd blockquote pre figcaption".split()
NOISE_TAGS = "script style noscript svg img picture video iframe header footer nav".split()
#: Parts of class names whose elements are no content.
NOISE_CLASSES = ["breadcrumb", "social-share", "share", "toolbar", "sidebar", "side-menu", "cookie", "login", "on-this-page", "print", "copyright", "commitment", "nav-card"]
#: Part of the class names of a hub's card titles.
CARD_CLASS = "card__title"

_KINDS = {"tag": "string", "up": "int", "last": "int", "first_text": "int", "end_text": "int", "named": "string", "role": "string", "ident": "string", "href": "string"}


class _Outline(HTMLParser):
    """Collects an outline column by column. End tags that are missing are not implied: an element ends with its end tag
    or with that of an element around it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.columns: dict[str, list] = {k: [] for k in _KINDS}
        self.texts: list[str] = []
        self.open: list[int] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_startendtag(tag, attrs)
        if tag not in EMPTY_TAGS:
            self.open.append(len(self.columns["tag"]) - 1)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = {k: v or "" for k, v in attrs}
        at, texts = len(self.columns["tag"]), len(self.texts)
        row = (tag, self.open[-1] if self.open else -1, at, texts, texts, given.get("class", ""), given.get("role", ""), given.get("id", ""), given.get("href", ""))
        for column, value in zip(self.columns.values(), row, strict=True):
            column.append(value)

    def handle_endtag(self, tag: str) -> None:
        tags = self.columns["tag"]
        if any(tags[k] == tag for k in self.open):
            while self.end() != tag:
                pass

    def handle_data(self, data: str) -> None:
        self.texts.append(unicodedata.normalize("NFKC", data))

    def end(self) -> str:
        """Ends the innermost open element and gives its tag."""
        at = self.open.pop()
        self.columns["last"][at] = len(self.columns["tag"]) - 1
        self.columns["end_text"][at] = len(self.texts)
        return self.columns["tag"][at]


def _parsed(html: str) -> _Outline:
    page = _Outline()
    page.feed(html)
    page.close()
    while page.open:
        page.end()
    return page


def outlines(pages: DataFrame, key_col: str = "filename", html_col: str = "html") -> DataFrame:
    """(key, elements, texts) of each page; rows without key or page are left out. Texts are in compatibility form."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [_parsed(x) for x in batch["html"]]
            yield pd.DataFrame({"key": batch["key"], "texts": [p.texts for p in read], **{k: [p.columns[k] for p in read] for k in _KINDS}})

    schema = "key string, texts array<string>, " + ", ".join(f"{k} array<{t}>" for k, t in _KINDS.items())
    rows = pages.where(F.col(key_col).isNotNull() & F.col(html_col).isNotNull()).select(F.col(key_col).cast("string").alias("key"), F.col(html_col).alias("html"))
    numbered = rows.mapInPandas(scan, schema).withColumn("at", F.when(F.size("tag") > 0, F.sequence(F.lit(0), F.size("tag") - 1)).otherwise(F.array().cast("array<int>")))
    return numbered.select("key", F.arrays_zip("at", *_KINDS).alias("elements"), "texts")


def _outlined(rows: DataFrame, key_col: str, html_col: str) -> DataFrame:
    return rows if "elements" in rows.columns else outlines(rows, key_col, html_col)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once; a column used inside a lambda may be worked out for each element."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def _inside(e: Column) -> Column:
    """The elements inside an element."""
    return F.slice("elements", e["at"] + 2, e["last"] - e["at"])


def _text(e: Column, texts: str | Column = "texts") -> Column:
    return X.squeezed(F.array_join(F.slice(texts, e["first_text"] + 1, e["end_text"] - e["first_text"]), ""))


def _tagged(e: Column, tags: list[str]) -> Column:
    return e["tag"].isin(tags)


def _content_root() -> Column:
    """main, else the element of that role, else article, else body, else the whole page."""
    first = lambda test: F.get(F.filter("elements", test), F.lit(0))
    tests = (lambda e: e["tag"] == "main", lambda e: e["role"] == "main", lambda e: e["tag"] == "article", lambda e: e["tag"] == "body")
    found = F.coalesce(*(first(t) for t in tests))
    part = lambda name, whole: F.coalesce(found[name], whole).cast("int").alias(name)
    return F.struct(part("at", F.lit(-1)), part("last", F.size("elements") - 1), part("first_text", F.lit(0)), part("end_text", F.size("texts")))


def _is_noise(e: Column) -> Column:
    named = F.lower(e["named"])
    classed = F.rlike(named, F.lit("|".join(NOISE_CLASSES)))
    return _tagged(e, NOISE_TAGS) | (e["role"] == "navigation") | (e["ident"] == "cookie") | classed


def sections(pages: DataFrame, key_col: str = "filename", html_col: str = "html", least_part: int = 10, least_section: int = 50) -> DataFrame:
    """(key, pos, heading, content): the sections of each page, from a heading to the next one.

    A noise heading begins no section. Without any section of more than ``least_section`` characters, the whole content is
    one, if it is as long. Empty pages give no row.
    """
    within = lambda noise, i: F.exists(noise, lambda n: (n["first_text"] <= i) & (i < n["end_text"]))
    long_enough = lambda s: F.length(s["content"]) > least_section
    content = lambda parts: X.squeezed(X.without_boilerplate(F.array_join(parts, "\n"))).alias("content")

    def blocks(root: Column, noise: Column, kept: Column) -> Column:
        """Headings and parts in order, with their texts; noise headings and short parts are left out."""
        wanted = lambda e: _tagged(e, HEADING_TAGS + PART_TAGS) & ~F.exists(noise, lambda n: (n["at"] <= e["at"]) & (e["at"] <= n["last"]))
        read = F.transform(F.filter(_inside(root), wanted), lambda e: F.struct(_tagged(e, HEADING_TAGS).alias("heads"), _text(e, kept).alias("text")))
        return F.filter(read, lambda b: F.when(b["heads"], ~F.lower(b["text"]).isin(NOISE_HEADINGS)).otherwise(F.length(b["text"]) > least_part))

    def cut(all_blocks: Column) -> Column:
        """From each heading to the next one; the first section has none."""
        heads = F.array_compact(F.transform(all_blocks, lambda b, i: F.when(b["heads"], i)))

        def section(start: Column, end: Column) -> Column:
            heading = F.when(start >= 0, F.get(all_blocks, F.greatest(start, F.lit(0)))["text"]).otherwise("")
            return F.struct(heading.alias("heading"), content(F.transform(F.slice(all_blocks, start + 2, end - start - 1), lambda b: b["text"])))

        bounded = lambda h: F.zip_with(F.concat(F.array(F.lit(-1)), h), F.concat(h, F.array(F.size(all_blocks))), section)
        return F.filter(_let(heads, bounded), long_enough)

    def whole(root: Column, noise: Column) -> Column:
        texts = F.filter("texts", lambda t, i: (root["first_text"] <= i) & (i < root["end_text"]) & ~within(noise, i))
        return F.filter(F.array(F.struct(F.lit("").alias("heading"), content(texts))), long_enough)

    def of_root(root: Column) -> Column:
        def of_noise(noise: Column) -> Column:
            kept = F.transform("texts", lambda t, i: F.when(within(noise, i), "").otherwise(t))
            formed = _let(kept, lambda k: _let(blocks(root, noise, k), cut))
            return _let(formed, lambda found: F.when(F.size(found) > 0, found).otherwise(whole(root, noise)))

        return _let(F.filter(_inside(root), _is_noise), of_noise)

    given = _outlined(pages, key_col, html_col).select("key", _let(_content_root(), of_root).alias("sections"))
    return given.select("key", F.posexplode("sections").alias("pos", "s")).select("key", "pos", "s.heading", "s.content")


def _short(elements: Column, limit: int = 100) -> Column:
    """The texts of elements, those that are empty or too long left out."""
    return F.filter(F.transform(elements, lambda e: _text(e)), lambda t: (t != "") & (F.length(t) < limit))


def _shape_headings(root: Column, inside: Column) -> Column:
    """Headings by which a page shows to be a hub: those of its cards, else of sections with many links, else linked ones,
    else those that are links on a page of links with little text."""
    count_of = lambda elements, test: F.size(F.filter(elements, test))
    heads = lambda e: _tagged(e, ["h2", "h3", "h4"]) | F.rlike(e["named"], F.lit("heading|title"))
    cards = F.transform(F.filter(inside, lambda e: F.rlike(e["named"], F.lit("[cC]ard"))), lambda c: F.get(F.filter(_inside(c), heads), F.lit(0)))
    links = lambda es: count_of(es, lambda e: e["tag"] == "a")
    paragraphs = lambda es: count_of(es, lambda e: e["tag"] == "p")
    linked = lambda s: _let(_inside(s), lambda es: (links(es) > 3) & (links(es) > 2 * paragraphs(es)))
    boxes = F.filter(inside, lambda e: F.when((e["tag"] == "section") | F.contains(e["named"], F.lit("content")), linked(e)).otherwise(F.lit(False)))
    in_boxes = F.flatten(F.transform(boxes, lambda s: F.filter(_inside(s), lambda e: _tagged(e, ["h2", "h3"]))))
    parent = lambda e: F.get(F.col("elements"), F.greatest(e["up"], F.lit(0)))["tag"]
    child_of = lambda tags, test: F.filter(inside, lambda e: (e["tag"] == "a") & test(e) & (e["up"] >= 0) & parent(e).isin(tags))
    addressed = lambda e: e["href"] != ""
    bare = (count_of(inside, lambda e: (e["tag"] == "a") & addressed(e)) > 6) & (paragraphs(inside) <= 3) & (F.length(_text(root)) < 2000)
    none = F.array().cast("array<string>")
    last = F.when(bare, _short(child_of(["h2", "h3", "h4"], addressed))).otherwise(none)
    third = _let(child_of(["h2", "h3"], lambda e: F.lit(True)), lambda es: F.when(F.size(es) >= 3, _short(es)).otherwise(none))
    first_of = lambda ways: ways[0] if len(ways) == 1 else _let(ways[0], lambda w: F.when(F.size(w) > 0, w).otherwise(first_of(ways[1:])))
    return first_of([_short(F.array_compact(cards)), _short(in_boxes), third, last])


def hubs(pages: DataFrame, key_col: str = "filename", html_col: str = "html", card_class: str = CARD_CLASS, by_shape: bool = False) -> DataFrame:
    """(key, is_hub, card_headings) of each page: by its card titles, three or more, whose distinct texts of under 150
    characters are the headings; or by its shape, for pages without such classes: three headings or more."""
    rows = _outlined(pages, key_col, html_col)
    if by_shape:
        headings = _let(_content_root(), lambda root: _let(_inside(root), lambda inside: _shape_headings(root, inside)))
        found = rows.select("key", headings.alias("card_headings"))
        return found.select("key", (F.size("card_headings") >= 3).alias("is_hub"), "card_headings")
    cards = F.filter("elements", lambda e: F.contains(e["named"], F.lit(card_class)))
    is_hub = F.size("cards") >= 3
    headings = F.when(is_hub, F.array_distinct(_short(F.col("cards"), 150))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("cards", cards).select("key", is_hub.alias("is_hub"), headings.alias("card_headings"))


def links(pages: DataFrame, key_col: str = "filename", html_col: str = "html") -> DataFrame:
    """(key, pos, href): the links of each page in order."""
    found = F.filter("elements", lambda e: (e["tag"] == "a") & (e["href"] != ""))
    return _outlined(pages, key_col, html_col).select("key", F.posexplode(F.transform(found, lambda e: e["href"])).alias("pos", "href"))


def child_links(links: DataFrame, bases: DataFrame, prefix: str = "/", host: str | None = None, most: int | None = None) -> DataFrame:
    """(key, pos, link): the addresses that a crawl follows from each page, in order and each once; pos is that of its
    first link. Links are made absolute and https; those to another host than ``host`` (or the page's own), outside the
    path ``prefix``, or to pages to skip are left out, and so are those after the first ``most``.

    ``links``: key, pos, href; ``bases``: key, url. A page without address gives nothing.
    """
    from pyspark.sql import Window

    rows = links.join(bases.select("key", F.col("url").alias("base")), "key").withColumn("link", U.to_https(U.url_join(F.col("base"), F.col("href"))))
    own = F.lit(host) if host is not None else U.authority(F.col("base"))
    kept = rows.where((U.authority(F.col("link")) == own) & U.under_prefix(F.col("link"), prefix) & ~U.should_skip(F.col("link")))
    once = kept.groupBy("key", "link").agg(F.min("pos").alias("pos"))
    if most is not None:
        order = F.row_number().over(Window.partitionBy("key").orderBy("pos"))
        once = once.withColumn("__n", order).where(F.col("__n") <= most).drop("__n")
    return once.select("key", "pos", "link")


@F.pandas_udf(T.StringType())
def _unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unescape(x))


def title(html: Column) -> Column:
    """A page's title as a browser shows it: character references resolved, white space squeezed; empty without one."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    plain = F.when(F.contains(raw, F.lit("&")), _unescaped(raw)).otherwise(raw)
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r\f]+", " "))
