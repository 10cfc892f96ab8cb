"""The main body of pages and of page texts, by tree scoring.

Saved pages: each paragraph passes points for its length and commas to its ancestors, less with each level;
a container's points are discounted by the share of its text that stands in links, and by its class names.
The best container and those of its siblings that score like it are the main body, without the navigation
and promotions inside them. One page is read at a time, inside Arrow batches of a scan; nothing is shuffled.

Page texts (chunks) have lost their tags, so a line is the paragraph and its points are its own: they are earned for
length and commas and discounted by a link density that is measured. The tree scoring of the saved pages tells for each
beginning of a line (its first three or four words, or a short line's all) on how many pages such lines stand outside the main body; the share of
its longest known beginning is a line's density. What the saved pages don't know is judged by how links, bylines,
notices and footers read (``CUES``, marks of links, menus). A line without points enough is not main body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import fold_text
from lexmill.session import materialize

#: How lines outside the main body begin or read, by kind; matched without bullets and the last full stop.
CUES = {
    "navigation": [
        r"home\s?[>›»/]",
        r"you are here\b",
        r"on this page\b",
        r"(?:skip|jump|go) to (?:the )?(?:main )?(?:content|article|text|search|main text)",
        r"back to (?:the )?top$",
        r"menu close\b",
        r"(?:all )?topics:",
        r"all guides\b.*\|",
    ],
    "cookies": [
        r"we use cookies\b",
        r"by (?:staying on|using)\b.*\bcookie policy$",
        r"(?:this|our) site stores\b.*\bon your device\b",
        r"your privacy matters to\b",
        r"accept all\b.{0,20}\b(?:settings|cookies)\b",
    ],
    "related": [
        r"(?:related|popular|trending)(?: now| pages| guides| links| articles)?\s?:",
        r"read (?:more|next)\b",
        r"(?:next|previous|prev)\s?[:»]",
        r"see also\b",
        r"you (?:may|might) also like\b",
        r"(?:more )?in this section$",
        r"(?:related|popular)$",
    ],
    "sharing": [
        r"share this (?:page|guide|article)\b",
        r"tell others about\b",
        r"like what you read\b",
        r"(?:follow|join) .{1,60} (?:for updates|on social media)$",
        r"subscribe to\b.*\b(?:mailing list|newsletter|updates)$",
        r"rate this (?:page|guide|article)\b",
        r"(?:was|is) this (?:page|guide|article) (?:useful|helpful)\b",
        r"did .{1,60} answer your question\b",
    ],
    "bylines": [
        r"written by(?: [^\s,.;]+){1,4}$",
        r"by (?:[^\s,]+ ){0,3}[^\s,]+, \d{1,2} [a-z]{3,9}\.? \d{4}$",
        r"posted (?:on )?\d{1,2} [a-z]{3,9}\.? \d{4}\b",
        r"(?:published|posted) by\b",
        r"[^|]{3,60}\| ?staff writer\b",
    ],
    "review dates": [
        r"last (?:reviewed|updated|modified|checked)\b.{0,20}\d{4}$",
        r"updated ?: ?\d{1,2} [a-z]{3,9}\.? \d{4}$",
        r"this page was (?:checked|reviewed|updated) on\b",
        r"page version \d+\b",
    ],
    "legal": [
        r"(?:©|\(c\)|copyright\b) ?\d{4}",
        r"information on .{1,60} is general\b",
        r"the content of .{1,60} is licen[sc]ed\b",
        r".{1,60} accepts no liability\b",
        r"you may copy this page\b",
        r".{1,60} acknowledges the traditional\b",
        r"warning: scams that use\b",
        r"privacy ?\|",
    ],
    "footers": [
        r"powered by\b",
        r"report a problem with this page$",
        r"call us on [\d ]{6,}",
        r".{1,60}, level \d+, \d+ .{1,40} (?:street|road|avenue|quay)$",
    ],
    "promotions": [
        r"advertisement$",
        r"sponsored (?:by|content)\b",
        r"join .{1,60} for a free\b",
    ],
}
#: Words of which menus consist once their links are gone.
MENU_WORDS = """home individuals businesses business agents forms contact menu close login log in register help search topics
income deductions super property privacy accessibility terms of use sitemap calculators webinars about news""".split()

#: Above this many characters a line is prose unless it begins or reads like one of ``LONG_CUES``.
LONGEST_NOTICE = 250
#: Breadcrumbs and lists of links, which hold no whole sentence, at any length.
_TRAILS = [
    r"home\s?[>›»/]",
    r"you are here\s?[:>›»/]",
    r"on this page\s?:",
    r"menu close\b",
    r"(?:all )?topics:",
    r"all guides\b.*\|",
    r"(?:related|popular|trending)(?: now| pages| guides| links| articles)?\s?:",
    r"(?:next|previous|prev)\s?[:»]",
    r"privacy ?\|",
]
LONG_CUES = [r"(?!.*[.!?]\s+\S)(?:" + "|".join(_TRAILS) + ")", *CUES["cookies"], *[x for x in CUES["legal"] if x not in _TRAILS]]

_PATTERNS = [x for group in CUES.values() for x in group]
_CUE = "(?i)^(?:" + "|".join(_PATTERNS) + ")"
#: The same for lines with their bullets and full stop.
_EDGE = r"^[-–—•*»«›‹\s]*"
_CUE_LINE = "(?i)" + _EDGE + "(?:" + "|".join(re.sub(r"\$$", r"[\\s.]*$", x) for x in _PATTERNS) + ")"
_MENU = "(?i)" + _EDGE + "(?:(?:" + "|".join(MENU_WORDS) + r")[:|]?\s?){4,}[\s.]*$"
_LONG_CUE = "(?:" + "|".join(LONG_CUES) + ")"
_LONG_LINE = "(?i)" + _EDGE + "(?:" + "|".join(re.sub(r"\$$", r"[\\s.]*$", x) for x in LONG_CUES) + ")"
#: Menus and pipe menus of any length, without groups that repeat, since those nest as deep as they repeat.
_LONG_MENU = r"(?i)\G(?:" + _EDGE[1:] + ")(?:" + "|".join(MENU_WORDS) + r")(?![a-z0-9])[:|]?\s?"
_LONG_PIPES = _EDGE + r"(?=[^|]*\|[^|]*\|)(?!.*\|\|)(?!.*[^|]{61})[^\d]*[^|\d]$"
_PIPES = _EDGE + r"[^|\d]{1,60}(?:\|[^|\d]{1,60}){2,}$"
_ARROWS = r"^\s*[»«›‹]|[»›]\s*$"


#: First words of a line by which it is known, and pages on which a beginning must stand to be known.
LEAST_WORDS, BEGINNING, KNOWN_PAGES = 3, 4, 20
#: Points of main body. A line that earns one point for a density that no page contradicts is out from 50 pages on, one
#: that earns four from 200 on.
LEAST_POINTS = 0.02
#: Characters of main body that a saved page must have for its lines to tell anything; error pages have fewer.
LEAST_BODY = 500
#: Bytes up to which the known beginnings are broadcast.
BROADCAST_BYTES = 32 << 20


def _bare(line: Column) -> Column:
    return F.trim(F.regexp_replace(fold_text(line), r"\s+", " "))


def _earned(bare: Column) -> Column:
    return 1 + F.regexp_count(bare, F.lit(",")) + F.least(F.floor(F.length(bare) / 100), F.lit(3))


def _reads_outside(bare: Column) -> Column:
    linked = F.rlike(bare, F.lit(_ARROWS)) | F.rlike(bare, F.lit(_CUE_LINE)) | F.rlike(bare, F.lit(_MENU)) | F.rlike(bare, F.lit(_PIPES))
    menu = F.rlike(F.regexp_replace(bare, _LONG_MENU, ""), F.lit(r"^[\s.]*$"))
    notice = F.rlike(bare, F.lit(_LONG_LINE)) | F.rlike(bare, F.lit(_LONG_PIPES)) | menu
    return F.when(F.length(bare) > LONGEST_NOTICE, notice).otherwise(linked)


def _points(bare: Column, density: Column | None = None) -> Column:
    """Points of a folded line. A density of null, or none at all, leaves it to how the line reads."""
    read = F.when(_reads_outside(bare), 0).otherwise(_earned(bare)).cast("double")
    if density is None:
        return read
    measured = _earned(bare) * (1 - density)
    # what is neither clearly outside nor mostly inside is left to how it reads
    return F.when((measured < LEAST_POINTS) | ((density < 0.5) & ~F.rlike(bare, F.lit(_ARROWS))), measured).otherwise(read)


def line_points(line: Column) -> Column:
    """Points of a line for which no density is measured: one, one for each comma, one for each hundred characters up to
    three, all times one less the line's link density, which is then one or none. Longer lines than a notice's are prose
    unless they are breadcrumbs, menus, lists of links, cookie notices or legal notices (``LONG_CUES``)."""
    return _points(_bare(line))


def _beginnings(bare: Column) -> Column:
    """Hashes of a folded line's first three and four words, or of the whole line if it has no more, which no longer line
    shares; the n-th is of n words. One or two words begin too many kinds of lines. Digits are alike."""
    head = F.regexp_replace(F.lower(F.substring(F.regexp_replace(bare, _EDGE, ""), 1, 120)), "[0-9]+", "0")
    tokens = F.slice(F.regexp_extract_all(head, F.lit(r"[\p{L}\p{N}]+|[>|:»«©/,]"), 0), 1, BEGINNING + 1)
    one = lambda t, n: F.when((F.size(t) > n) & (n >= LEAST_WORDS), F.xxhash64(F.array_join(F.slice(t, F.lit(1), n), " "))).when(F.size(t) == n, F.xxhash64(F.array_join(t, " "), F.lit("whole")))
    return F.get(F.transform(F.array(tokens), lambda t: F.transform(F.sequence(F.lit(1), F.lit(BEGINNING)), lambda n: one(t, n))), F.lit(0))


def measured_densities(lines: DataFrame, known_pages: int = KNOWN_PAGES) -> DataFrame:
    """(beginning, words, density) of the beginnings that stand on ``known_pages`` saved pages or more: the share of those
    pages that have such a line outside the main body. ``lines``: key, line, beyond (outside by the tree alone, or null)."""
    each = lines.where("beyond IS NOT NULL").select("key", "beyond", F.posexplode(_beginnings(_bare(F.col("line")))).alias("n", "beginning")).where("beginning IS NOT NULL")
    by_page = each.groupBy("beginning", "n", "key").agg(F.max(F.col("beyond").cast("int")).alias("out"), F.max((~F.col("beyond")).cast("int")).alias("in"))
    counted = by_page.groupBy("beginning", "n").agg(F.sum("out").alias("out"), F.sum("in").alias("in"))
    share = F.col("out") / (F.col("out") + F.col("in") + 1)
    return counted.where(F.col("out") + F.col("in") >= known_pages).select("beginning", (F.col("n") + 1).alias("words"), share.alias("density"))


def _with_density(lines: DataFrame, densities: DataFrame) -> DataFrame:
    """``lines`` (with ``line``, folded) with ``density``: that of the longest known beginning. A short beginning within
    which most stands in the main body tells too little and gives none."""
    many = densities.count()
    known = densities.withColumnsRenamed({"beginning": "__b", "words": "__w"})
    rows = lines.withColumn("__heads", _beginnings(F.col("line")))
    for n in range(1, BEGINNING + 1):
        side = known.where(F.col("__w") == n).select(F.col("__b").alias(f"__b{n}"), F.col("density").alias(f"__d{n}"))
        rows = rows.withColumn(f"__h{n}", F.get("__heads", F.lit(n - 1)))
        rows = rows.join(F.broadcast(side) if many * 64 <= BROADCAST_BYTES else side, F.col(f"__h{n}") == F.col(f"__b{n}"), "left").drop(f"__b{n}")
    longest = F.coalesce(*(F.col(f"__d{n}") for n in range(BEGINNING, 0, -1)))
    density = F.when((longest >= 0.5) | F.col(f"__d{BEGINNING}").isNotNull(), longest)
    return rows.withColumn("density", density).drop("__heads", *(f"__{x}{n}" for x in "hd" for n in range(1, BEGINNING + 1)))


def text_lines_outside(chunks: DataFrame, id_col: str = "id", text_col: str = "text", densities: DataFrame | None = None) -> DataFrame:
    """(id, line_no) of the lines of page texts that are not main body; blank lines are never given."""
    bare = F.transform(F.split("text", "\n", -1), _bare)
    lines = (
        chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.col("id").isNotNull() & F.col("text").isNotNull())
        .select("id", F.posexplode(bare).alias("at", "line"))
        .where(F.col("line") != "")
    )
    points = _points(F.col("line"))
    if densities is not None:
        lines, points = _with_density(lines, densities), _points(F.col("line"), F.col("density"))
    return lines.where(points < LEAST_POINTS).select("id", (F.col("at") + 1).alias("line_no")).distinct()


_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_UNSEEN = set("head script style noscript template title svg".split())
_LEAF = set("p li td th dd dt blockquote pre h1 h2 h3 h4 h5 h6 figcaption".split())
_BLOCKS = _LEAF | set("div section article main aside nav footer header ul ol table tr tbody form body html".split())
#: An opening tag of these closes an open one of the set.
_CLOSES = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dd": {"dd", "dt", "p"}, "dt": {"dd", "dt", "p"}}
_AGAINST = re.compile(
    r"(?i)(?:^|[\s_-])(?:nav|navigation|menu|mnu|footer|btm|bottom|side(?:bar)?|aside|related|promo|advert\w*|ads?|sponsor\w*|banner"
    r"|cookies?|ck|consent|share|social|breadcrumbs?|bc|skip|subscribe|newsletter|comments?|popup|modal)(?:[\s_-]|$)"
)
_FOR = re.compile(r"(?i)(?:^|[\s_-])(?:main|article|content|body|post|text|entry)(?:[\s_-]|$)")
_LINE_CUE = re.compile(_CUE)
_LONG_LINE_CUE = re.compile("(?i)^" + _LONG_CUE)


class _Node:
    __slots__ = ("tag", "names", "up", "below", "size", "linked", "points", "lines")

    def __init__(self, tag: str, names: str, up: _Node | None) -> None:
        self.tag, self.names, self.up = tag, names, up
        self.below: list[_Node] = []
        self.size = self.linked = 0
        self.points = 0.0
        self.lines: list[tuple[int, str]] = []

    def density(self) -> float:
        return self.linked / self.size if self.size else 0.0

    def walk(self) -> Iterator[_Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.below))


class _Tree(HTMLParser):
    """Element tree with the visible lines of each element; end tags may be missing or out of place."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("html", "", None)
        #: Texts in the order of the page, blank ones too: (element, line number, text).
        self.pieces: list[tuple[_Node, int, str]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _VOID or tag == "html":
            return
        closes = _CLOSES.get(tag, {"p", "h1", "h2", "h3", "h4", "h5", "h6"} if tag in _BLOCKS else set())
        while self.at.tag in closes and self.at.up is not None:
            self.at = self.at.up
        names = " ".join(v for k, v in attrs if k in ("class", "id", "role") and v)
        node = _Node(tag, names, self.at)
        self.at.below.append(node)
        self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.up
        if node is not None and node.up is not None:
            self.at = node.up

    def handle_data(self, data: str) -> None:
        first = self.getpos()[0]
        self.pieces += [(self.at, first + k, x) for k, x in enumerate(data.split("\n")) if x]
        if not data.strip():
            return
        node, link = self.at, False
        while node is not None:
            if node.tag in _UNSEEN:
                return
            link = link or node.tag in ("a", "button")
            node = node.up
        self.at.lines += [(first + k, x.strip()) for k, x in enumerate(data.split("\n")) if x.strip()]
        size, node = len(data.strip()), self.at
        while node is not None:
            node.size += size
            node.linked += size * link
            node = node.up


def _score(root: _Node) -> None:
    for node in root.walk():
        own = node.tag in _LEAF or (node.tag in ("div", "span") and any(len(x) >= 25 for _, x in node.lines))
        if not own or node.size < 25 or node.tag[0] == "h" and node.tag[1:].isdigit():
            continue
        text = " ".join(x for n in node.walk() for _, x in n.lines)
        points = (1 + text.count(",") + min(len(text) // 100, 3)) * (1 - node.density())
        up, share = node.up, 1.0
        while up is not None and share > 0.1:
            up.points += points * share
            share, up = share / 2, up.up


def _standing(node: _Node) -> float:
    weight = 25 * bool(_FOR.search(node.names) or node.tag in ("main", "article"))
    weight -= 25 * bool(_AGAINST.search(node.names) or node.tag in ("nav", "aside", "footer", "header"))
    return (node.points + weight) * (1 - node.density())


def _read(html: str) -> _Tree:
    tree = _Tree()
    tree.feed(html)
    tree.close()
    return tree


def _main_nodes(tree: _Tree, worded: bool = True) -> list[_Node]:
    """The elements of a page that are main body, each without those below it. How lines read counts if ``worded``."""
    _score(tree.root)
    places = [n for n in tree.root.walk() if n.tag in _BLOCKS and n.tag not in _LEAF and n.points > 0 and n.tag not in ("html", "body")]
    best = max(places, key=_standing, default=None)
    if best is None or _standing(best) <= 0:
        best = next((n for n in tree.root.walk() if n.tag in ("main", "article", "body")), tree.root)
    has_title = lambda n: any(x.tag == "h1" for x in n.walk())
    while best.up is not None and best.up.tag not in ("html", "body") and not has_title(best) and has_title(best.up) and best.up.density() < 0.5:
        best = best.up
    kept = [best]
    if best.up is not None:
        least = max(10.0, 0.2 * _standing(best))
        for other in best.up.below:
            prose = other.tag == "p" and other.size > 80 and other.density() < 0.25
            if other is not best and (prose or other.tag == "h1" or (other.tag in _BLOCKS and _standing(other) >= least)):
                kept.append(other)
    inside: list[_Node] = []
    stack = list(kept)
    while stack:
        node = stack.pop()
        if node not in kept:
            box = node.tag in _BLOCKS and node.tag not in _LEAF
            against = _AGAINST.search(node.names) or node.tag in ("nav", "aside", "footer")
            if box and (against or (node.size and node.density() >= 0.5)):
                continue
            if worded and not (node.tag[0] == "h" and node.tag[1:].isdigit()) and len(node.lines) == 1:
                line = re.sub(r"^[-–—•*»«›‹\s]+|[\s.]+$", "", re.sub(r"\s+", " ", node.lines[0][1]))
                if (_LINE_CUE if len(line) <= LONGEST_NOTICE else _LONG_LINE_CUE).search(line):
                    continue
        inside.append(node)
        stack.extend(node.below)
    return inside


def visible_lines(html: str | None) -> list[tuple[int, str, bool | None, bool]]:
    """(line number, text, outside by the tree alone, outside) of the lines of a page with visible text. Of a page with
    hardly any main body the tree tells nothing."""
    if not html or not html.strip():
        return []
    tree = _read(html)
    kept = {no for node in _main_nodes(tree) for no, _ in node.lines}
    for node in tree.root.walk():
        node.points = 0.0
    nodes = _main_nodes(tree, worded=False)
    standing = {no for node in nodes for no, _ in node.lines}
    tells = sum(len(text) for node in nodes for _, text in node.lines) >= LEAST_BODY
    texts: dict[int, list[str]] = {}
    seen = {id(node) for node in tree.root.walk() if node.lines}
    for node, no, text in tree.pieces:
        if id(node) in seen and text.strip():
            texts.setdefault(no, []).append(text.strip())
    return [(no, " ".join(parts), no not in standing if tells else None, no not in kept) for no, parts in texts.items()]


def lines_outside_main(html: str | None) -> list[int]:
    """Numbers of the lines of a page that hold visible text outside its main body."""
    return sorted({no for no, _, _, out in visible_lines(html) if out})


def main_text_of(html: str | None) -> str | None:
    """The visible text of a page's main body, a line for each line of the page and each block on it."""
    if html is None:
        return None
    tree = _read(html)
    inside = {id(node) for node in _main_nodes(tree) if node.lines or node.below}
    lines: list[list[str]] = []
    last = None
    for node, no, text in tree.pieces:
        if id(node) not in inside or node.tag in _UNSEEN:
            continue
        block = node
        while block.tag not in _BLOCKS and block.up is not None:
            block = block.up
        if last != (no, id(block)):
            lines.append([])
            last = (no, id(block))
        lines[-1].append(text)
    joined = (re.sub(r"\s+", " ", "".join(x)).strip() for x in lines)
    return "\n".join(x for x in joined if x)


def page_lines(pages: DataFrame, key_col: str = "filename", html_col: str = "html") -> DataFrame:
    """(key, line_no, line, beyond, outside) of the visible lines of each page; null keys and pages give nothing."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, *line) for key, html in zip(batch["key"], batch["html"], strict=True) for line in visible_lines(html)]
            yield pd.DataFrame(rows, columns=["key", "line_no", "line", "beyond", "outside"]).astype({"beyond": "boolean"})

    return (
        pages.select(F.col(key_col).cast("string").alias("key"), F.col(html_col).alias("html"))
        .where(F.col("key").isNotNull() & F.col("html").isNotNull())
        .mapInPandas(scan, "key string, line_no int, line string, beyond boolean, outside boolean")
    )


def page_lines_outside(pages: DataFrame, key_col: str = "filename", html_col: str = "html") -> DataFrame:
    """(key, line_no) of the visible lines outside each page's main body; null keys and pages give nothing."""
    return page_lines(pages, key_col, html_col).where("outside").select("key", "line_no").distinct()


def page_main_text(pages: DataFrame, key_col: str = "filename", html_col: str = "html") -> DataFrame:
    """(key, text_main): the main body's visible text of each saved page, null for a null page; null keys give nothing."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"key": batch["key"], "text_main": [main_text_of(x) for x in batch["html"]]})

    return (
        pages.select(F.col(key_col).cast("string").alias("key"), F.col(html_col).alias("html"))
        .where(F.col("key").isNotNull())
        .mapInPandas(scan, "key string, text_main string")
        .distinct()
    )


def main_body(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(src_table, rec_key, text_main): the main body of every chunk and of every saved page."""
    densities = materialize(measured_densities(page_lines(pages)))
    texts = main_text(chunks.select("id", "text"), densities=densities).select(F.lit("chunks").alias("src_table"), F.col("id").alias("rec_key"), "text_main").distinct()
    html = page_main_text(pages).select(F.lit("rawhtml").alias("src_table"), F.col("key").alias("rec_key"), "text_main")
    return texts.unionByName(html)


def outside_main_body(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """(src_table, rec_key, line_no) of every line of chunks and saved pages that is not main body."""
    # the pages are parsed once, for their own lines and for the densities
    seen = materialize(page_lines(pages))
    densities = materialize(measured_densities(seen))
    texts = text_lines_outside(chunks, densities=densities).select(F.lit("chunks").alias("src_table"), F.col("id").alias("rec_key"), "line_no")
    html = seen.where("outside").select(F.lit("rawhtml").alias("src_table"), F.col("key").alias("rec_key"), "line_no").distinct()
    return texts.unionByName(html)


def main_text(chunks: DataFrame, text_col: str = "text", id_col: str = "id", densities: DataFrame | None = None) -> DataFrame:
    """``chunks`` with ``text_main``: the lines of the text that are main body. All rows and columns stay; with densities,
    rows without id are judged by how their lines read."""
    # each line is folded once, before it is judged
    lines = F.transform(F.split(F.col(text_col), "\n", -1), lambda x: F.struct(x.alias("line"), _bare(x).alias("bare")))
    kept = F.filter(lines, lambda x: (x["bare"] == "") | (_points(x["bare"]) >= LEAST_POINTS))
    read = F.array_join(F.transform(kept, lambda x: x["line"]), "\n")
    if densities is None:
        return chunks.withColumn("text_main", read)
    gone = text_lines_outside(chunks, id_col, text_col, densities).groupBy(F.col("id").alias("__of")).agg(F.collect_set("line_no").alias("__gone"))
    joined = chunks.drop("text_main").join(gone, F.col(id_col) == F.col("__of"), "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    by_number = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(F.col("__gone"), i + 1)), "\n")
    return joined.withColumn("text_main", F.when(F.col(id_col).isNull(), read).otherwise(by_number)).drop("__of", "__gone")
