"""Registered queries of the core and the SQL that they are held against. Every query reads whole tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lexmill.config import BROAD_PATHS, HEADING_STOP_WORDS, NARROW_PATHS, NARROW_TERMS, STOP_WORDS, Settings
from lexmill.functions import text as X
from lexmill.functions import urls as U
from lexmill.functions import vectors as V
from lexmill.operators import answers, chunking, dense, docs, evaluation, fusion, html, inventory, keywords, sparse
from lexmill.plans import retrieval
from lexmill.session import materialize
from lexmill.sources.tables import site_of, table

QUERIES: dict = {}
ORACLES: dict = {}
DISCLAIMER = "This is general information only."
#: White space as Unicode has it, since the class in the SQL's regular expressions is ASCII only. In SQL it is @S.
_SPACE = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql.replace("@S", _SPACE)
        return f

    return register


# -- addresses -----------------------------------------------------------------------------------------------------

_SQL_PATH = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)?([^?#]*)', 1)"
_SQL_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1)"
#: Path segments above an address: (url, base, s, d) with s the parts of the path and d the depth.
_SQL_ABOVE = rf"""p AS (SELECT DISTINCT url, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*://)', 1) || {_SQL_HOST} AS base, string_split(regexp_replace({_SQL_PATH}, '/+$', ''), '/') AS s FROM inventory WHERE url IS NOT NULL),
a AS (SELECT url, d, base || array_to_string(s[1:d], '/') AS hub, coalesce(s[d + 1], '') AS child FROM (SELECT *, unnest(range(1, len(s))) AS d FROM p))"""


def _sql_keywords(text: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower({text}), '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND NOT list_contains({_SQL_STOP}, w))"


@query(rf"SELECT inv_id, 'https://' || {_SQL_HOST} || regexp_replace({_SQL_PATH}, ';[^/]*$', '') AS canonical FROM inventory WHERE url IS NOT NULL")
def url_canonicalize(spark, d):
    return table(spark, d, "inventory").where("url IS NOT NULL").select("inv_id", U.to_https(F.col("url")).alias("canonical"))


@query(r"""SELECT inv_id, regexp_matches(lower(url), '^(mailto|tel):|/share/|/print/|/download/|/search\?|[?&](page|sort|order|view|start|from|to|size|limit)=') AS skipped,
 (regexp_replace(""" + _SQL_PATH + r""", '/+$', '') = '/individuals' OR starts_with(regexp_replace(""" + _SQL_PATH + r""", '/+$', ''), '/individuals/')) AS below
FROM inventory WHERE url IS NOT NULL""")
def url_skip_filter(spark, d):
    return table(spark, d, "inventory").where("url IS NOT NULL").select("inv_id", U.should_skip(F.col("url")).alias("skipped"), U.under_prefix(F.col("url"), "/individuals").alias("below"))


@query(rf"""WITH p AS (SELECT DISTINCT url, trim({_SQL_PATH}, '/') AS path FROM chunks WHERE url IS NOT NULL),
s AS (SELECT url, CASE WHEN path = '' THEN [] ELSE list_transform(string_split(path, '/'), lambda x: replace(x, '-', ' ')) END AS parts FROM p)
SELECT url, array_to_string(list_transform(parts, lambda x: array_to_string(list_transform(range(1, length(x) + 1), lambda i: CASE WHEN i = 1 OR NOT regexp_matches(x[i - 1], '\p{{L}}') THEN upper(x[i]) ELSE lower(x[i]) END), '')), ' > ') AS breadcrumb FROM s""")
def url_breadcrumb(spark, d):
    return table(spark, d, "chunks").where("url IS NOT NULL").select("url").distinct().select("url", U.breadcrumb(F.col("url")).alias("breadcrumb"))


_SQL_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


@query(rf"""WITH s AS (SELECT inv_id, generate_subscripts(string_split(trim({_SQL_PATH}, '/'), '/'), 1) AS k, unnest(string_split(trim({_SQL_PATH}, '/'), '/')) AS seg FROM inventory WHERE url IS NOT NULL),
w AS (SELECT inv_id, k, generate_subscripts(p, 1) AS j, unnest(p) AS w FROM (SELECT inv_id, k, regexp_split_to_array(regexp_replace(lower(replace(seg, '-', ' ')), '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+') AS p FROM s)),
f AS (SELECT inv_id, w, min(k * 1000 + j) AS o FROM w WHERE length(w) > 1 AND NOT list_contains({_SQL_STOP}, w) GROUP BY inv_id, w),
g AS (SELECT inv_id, string_agg(w, ' ' ORDER BY o) AS words FROM f GROUP BY inv_id)
SELECT i.inv_id, coalesce(g.words, '') AS words FROM inventory i LEFT JOIN g USING (inv_id) WHERE i.url IS NOT NULL""")
def url_keywords(spark, d):
    return table(spark, d, "inventory").where("url IS NOT NULL").select("inv_id", F.array_join(X.url_keywords(F.col("url")), " ").alias("words"))


@query(rf"""WITH p AS (SELECT inv_id, CASE WHEN trim({_SQL_PATH}, '/') = '' THEN 'index' ELSE trim({_SQL_PATH}, '/') END AS p FROM inventory WHERE url IS NOT NULL)
SELECT inv_id, CASE WHEN length(p) + 5 + (length(p) - length(replace(p, '/', ''))) > 200 THEN left(replace(p, '/', '__') || '.html', 190) || '__' || left(md5(p), 8) || '.html' ELSE replace(p, '/', '__') || '.html' END AS file FROM p""")
def url_filename(spark, d):
    return table(spark, d, "inventory").where("url IS NOT NULL").select("inv_id", U.filename(F.col("url")).alias("file"))


@query(rf"""WITH p AS (SELECT inv_id, url, {_SQL_HOST} AS host, string_split(regexp_replace({_SQL_PATH}, '/+$', ''), '/') AS s FROM inventory WHERE url IS NOT NULL),
b AS (SELECT inv_id, host, CASE WHEN len(s) >= 4 THEN array_to_string(s[1:4], '/') ELSE array_to_string(s, '/') END AS branch FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY host, branch ORDER BY inv_id) AS branch_pos FROM b)
SELECT inv_id, host, branch, branch_pos FROM r WHERE branch_pos <= 50""")
def branch_cap(spark, d):
    rows = table(spark, d, "inventory").where("url IS NOT NULL")
    return inventory.capped_by_branch(rows, Settings.from_env().branch_cap, "inv_id").select("inv_id", "host", "branch", F.col("branch_pos").cast("long").alias("branch_pos"))


@query(rf"""WITH p AS (SELECT inv_id, url, filename, title, {_SQL_HOST} AS host, string_split(regexp_replace({_SQL_PATH}, '/+$', ''), '/') AS s FROM inventory WHERE url IS NOT NULL),
t AS (SELECT p.inv_id, p.host, CASE WHEN len(s) >= 4 THEN array_to_string(s[1:4], '/') ELSE array_to_string(s, '/') END AS branch,
  CASE WHEN coalesce(p.filename, '') = '' THEN CASE WHEN lower(trim(coalesce(p.title, ''))) = 'access denied' THEN 'blocked' ELSE 'fetch-error' END
  WHEN h.url IS NOT NULL THEN 'hub' WHEN p.inv_id > f.first THEN 'leaf-dup' WHEN c.url IS NOT NULL THEN 'leaf' ELSE 'leaf-empty' END AS type
  FROM p LEFT JOIN (SELECT DISTINCT url FROM hubs) h ON h.url = p.url LEFT JOIN (SELECT DISTINCT url FROM chunks) c ON c.url = p.url
  LEFT JOIN (SELECT url, min(inv_id) AS first FROM inventory WHERE filename <> '' GROUP BY url) f ON f.url = p.url),
r AS (SELECT *, row_number() OVER w AS branch_pos, count(*) FILTER (WHERE type = 'leaf') OVER (PARTITION BY host, branch ORDER BY inv_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM t WINDOW w AS (PARTITION BY host, branch ORDER BY inv_id))
SELECT inv_id, host, branch, type, branch_pos FROM r WHERE before < 50""")
def crawl_cap(spark, d):
    """The pages that a crawl in the order of the inventory takes: of a branch, up to its fiftieth first leaf with chunks."""
    rows = inventory.typed(table(spark, d, "inventory").where("url IS NOT NULL"), table(spark, d, "hubs"), table(spark, d, "chunks"))
    kept = inventory.capped_by_branch(rows, Settings.from_env().branch_cap, "inv_id", counts=F.col("type") == "leaf")
    return kept.select("inv_id", "host", "branch", "type", F.col("branch_pos").cast("long").alias("branch_pos"))


@query(f"WITH {_SQL_ABOVE} SELECT url, d AS depth, hub AS ancestor, child FROM a")
def url_ancestors(spark, d):
    rows = table(spark, d, "inventory").where("url IS NOT NULL").select("url").distinct().select("url", F.explode(U.ancestors(F.col("url"))).alias("a"))
    return rows.select("url", F.col("a.depth").cast("long").alias("depth"), F.col("a.url").alias("ancestor"), F.col("a.child").alias("child"))


# -- texts ---------------------------------------------------------------------------------------------------------


#: The compatibility forms that stand in the texts: full-width characters, dots in one, ideographic and no-break spaces.
_WIDE, _NARROW = "".join(chr(c) for c in range(0xFF01, 0xFF5F) if c != 0xFF07), "".join(chr(c) for c in range(0x21, 0x7F) if c != 0x27)


@query(rf"""WITH bare AS (SELECT DISTINCT id, regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(text, 'BEGIN NOINDEX', ''), 'END NOINDEX', ''), 'Skip to main content', ''), 'Skip To search', ''), 'Report webpage issue', ''), 'Print or Download', ''),
  '\bQC\s*\d+\b', '', 'g'), 'Last updated\s*\d+\s*\w+\s*\d{{4}}', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM chunks WHERE text IS NOT NULL),
folded AS (SELECT id, replace(translate(t, '{_WIDE}', '{_NARROW}'), '…', '...') AS t FROM bare),
spaced AS (SELECT id, regexp_replace(regexp_replace(regexp_replace(t, '[\x{{a0}}\x{{2007}}\x{{202f}}\x{{3000}}]', ' ', 'g'), '[\x{{200b}}-\x{{200f}}\x{{202a}}-\x{{202e}}]', '', 'g'), '[ \t\r\f\v]+', ' ', 'g') AS t FROM folded)
SELECT DISTINCT id, regexp_replace(t, '^@S+|@S+$', '', 'g') AS cleaned FROM spaced""")
def text_clean(spark, d):
    return table(spark, d, "chunks").where("text IS NOT NULL").select("id", X.clean_text(F.col("text")).alias("cleaned")).distinct()


@query(r"""SELECT doc_id, CAST(floor(len(list_filter(regexp_split_to_array(text, '@S+'), lambda x: x <> '')) * 1.3::DOUBLE) AS BIGINT) AS tokens FROM documents WHERE text IS NOT NULL""")
def token_count(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", X.token_count(F.col("text")).cast("long").alias("tokens"))


@query(rf"""SELECT DISTINCT id, array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower(section_heading), '[^a-zA-Z0-9\s-]', ' ', 'g'), '\s+'), lambda w: length(w) > 1 AND NOT list_contains({_SQL_STOP}, w)), ' ') AS words FROM chunks WHERE section_heading IS NOT NULL""")
def extract_keywords(spark, d):
    return table(spark, d, "chunks").where("section_heading IS NOT NULL").select("id", F.array_join(X.keywords(F.col("section_heading")), " ").alias("words")).distinct()


@query(r"""SELECT doc_id, generate_subscripts(s, 1) - 1 AS pos, unnest(s) AS sentence FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])@S+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)""")
def sentence_split(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(X.sentences(F.col("text"))).alias("pos", "sentence")).withColumn("pos", F.col("pos").cast("long"))


@query(r"""SELECT DISTINCT id, left(sha1(url), 10) || '_' || CASE WHEN chunk_index + 1 < 1000 THEN lpad(CAST(chunk_index + 1 AS VARCHAR), 3, '0') ELSE CAST(chunk_index + 1 AS VARCHAR) END AS made FROM chunks WHERE url IS NOT NULL AND chunk_index IS NOT NULL""")
def chunk_id(spark, d):
    return table(spark, d, "chunks").where("url IS NOT NULL AND chunk_index IS NOT NULL").select("id", X.chunk_id(F.col("url"), F.col("chunk_index")).alias("made")).distinct()


@query(r"""SELECT id, content_hash FROM (SELECT id, sha1(text) AS content_hash, row_number() OVER (PARTITION BY sha1(text) ORDER BY id) AS k FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL) WHERE k = 1""")
def content_dedup(spark, d):
    return inventory.first_of_content(table(spark, d, "chunks").where("id IS NOT NULL"), "text", "id").select("id", "content_hash")


@query(r"""SELECT inv_id, trim(regexp_replace(title, '\s*\|.*$', ''), ' ' || chr(9) || chr(10) || chr(160)) AS bare FROM inventory WHERE title IS NOT NULL""")
def title_strip(spark, d):
    return table(spark, d, "inventory").where("title IS NOT NULL").select("inv_id", X.page_title(F.col("title")).alias("bare"))


# -- saved pages ---------------------------------------------------------------------------------------------------


@query(r"""SELECT filename, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM rawhtml""")
def page_title(spark, d):
    return table(spark, d, "rawhtml").select("filename", html.title(F.col("html")).alias("title"))


def _page_addresses(spark, d):
    saved = table(spark, d, "inventory").where("filename <> '' AND url IS NOT NULL")
    return saved.groupBy(F.col("filename").alias("key")).agg(F.min("url").alias("url"))


@query(rf"""WITH page AS (SELECT filename AS key, min(url) AS base FROM inventory WHERE filename <> '' AND url IS NOT NULL GROUP BY filename),
h AS (SELECT filename AS key, generate_subscripts(hs, 1) - 1 AS pos, unnest(hs) AS href FROM (SELECT filename, list_filter(regexp_extract_all(html, '(?is)<a\s[^>]*?href\s*=\s*["'']([^"'']*)["'']', 1), lambda x: x <> '') AS hs FROM rawhtml)),
j AS (SELECT h.key, pos, base, replace(href, '&amp;', '&') AS href FROM h JOIN page ON page.key = h.key),
u AS (SELECT key, pos, base, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\-]*:') THEN href WHEN href LIKE '/%' THEN regexp_extract(base, '^[^/]*//[^/]*') || href ELSE base END AS url FROM j),
l AS (SELECT key, pos, {_SQL_HOST} AS host, regexp_extract(base, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)', 1) AS own, 'https://' || {_SQL_HOST} || {_SQL_PATH} AS link FROM u)
SELECT key, link, min(pos) AS pos FROM l WHERE host = own AND NOT regexp_matches(lower(link), '/share/|/print/|/download/') GROUP BY key, link""")
def page_links(spark, d):
    """The addresses on the same host that each saved page leads to."""
    found = html.child_links(html.links(table(spark, d, "rawhtml")), _page_addresses(spark, d))
    return found.withColumn("pos", F.col("pos").cast("long"))


@query()
def hub_detect(spark, d):
    return html.hubs(table(spark, d, "rawhtml"), by_shape=True).select("key", "is_hub", F.array_join("card_headings", " | ").alias("cards"))


@query()
def html_sections(spark, d):
    return html.sections(table(spark, d, "rawhtml"))


@query()
def page_chunks(spark, d):
    inv = table(spark, d, "inventory").where("filename <> '' AND url IS NOT NULL").select(F.col("filename").alias("key"), "url", "title")
    rows = chunking.page_chunks(html.sections(table(spark, d, "rawhtml")), inv)
    return rows.withColumn("keywords", F.array_join("keywords", " "))


_SQL_TOKENS = r"CAST(floor(len(list_filter(regexp_split_to_array({0}, '@S+'), lambda x: x <> '')) * 1.3::DOUBLE) AS INTEGER)"


@query(r"""WITH s AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '([.!?])@S+', '\1' || chr(1), 'g'), chr(1)), lambda t: {'t': t, 'n': """ + _SQL_TOKENS.format("t") + r"""}) AS s FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_prepend({'t': '', 'n': 0, 'done': []::VARCHAR[]}, list_transform(s, lambda x: {'t': x.t, 'n': x.n, 'done': []::VARCHAR[]})),
  lambda a, x: CASE WHEN a.n + x.n > 384 AND a.t <> '' THEN {'t': x.t, 'n': x.n, 'done': list_append(a.done, a.t)}
    ELSE {'t': CASE WHEN a.t <> '' THEN a.t || ' ' || x.t ELSE x.t END, 'n': a.n + x.n, 'done': a.done} END) AS r FROM s),
p AS (SELECT doc_id, unnest(list_append(r.done, r.t)) AS piece FROM f),
t AS (SELECT doc_id, regexp_replace(piece, '^@S+|@S+$', '', 'g') AS piece FROM p)
SELECT doc_id, piece, CAST(""" + _SQL_TOKENS.format("piece") + r""" AS BIGINT) AS tokens FROM t WHERE """ + _SQL_TOKENS.format("piece") + r""" >= 60""")
def chunk_pack(spark, d):
    s = Settings.from_env()
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.explode(chunking.packed(F.col("text"), s.chunk_max_tokens, s.chunk_min_tokens)).alias("piece"))
    return rows.withColumn("tokens", X.token_count(F.col("piece")).cast("long"))


@query(r"""WITH s AS (SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '\n+'), lambda t: t <> ''), lambda t: {'t': t, 'n': """ + _SQL_TOKENS.format("t") + r"""}) AS s FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, list_reduce(list_prepend({'t': '', 'n': 0, 'done': []::VARCHAR[]}, list_transform(s, lambda x: {'t': x.t, 'n': x.n, 'done': []::VARCHAR[]})),
  lambda a, x: CASE WHEN a.n + x.n <= 384 THEN {'t': CASE WHEN a.t <> '' THEN a.t || chr(10) || chr(10) || x.t ELSE x.t END, 'n': a.n + x.n, 'done': a.done}
    ELSE {'t': x.t, 'n': x.n, 'done': CASE WHEN a.t <> '' THEN list_append(a.done, a.t) ELSE a.done END} END) AS r FROM s),
l AS (SELECT doc_id, CASE WHEN r.t <> '' THEN list_append(r.done, r.t) ELSE r.done END AS m FROM f)
SELECT doc_id, generate_subscripts(m, 1) - 1 AS pos, unnest(m) AS content FROM l""")
def chunk_merge(spark, d):
    paragraphs = F.transform(F.filter(F.split("text", r"\n+"), lambda t: t != ""), lambda t: F.struct(F.lit("").alias("heading"), t.alias("content")))
    rows = table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(chunking.merged(paragraphs, Settings.from_env().chunk_max_tokens)).alias("pos", "s"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), F.col("s.content").alias("content"))


@query(rf"""WITH {_SQL_ABOVE},
c AS (SELECT url AS hub, generate_subscripts(card_headings, 1) AS o, unnest(card_headings) AS card FROM (SELECT url, max(card_headings) AS card_headings FROM hubs GROUP BY url)),
m AS (SELECT a.url, a.d, c.o, {_sql_keywords('c.card')} AS kw FROM a JOIN c ON c.hub = a.hub WHERE c.card IS NOT NULL AND list_has_any({_sql_keywords('c.card')}, {_sql_keywords("replace(a.child, '-', ' ')")})),
lv AS (SELECT url, d, sum(len(kw)) AS n FROM m GROUP BY url, d),
inc AS (SELECT url, d, coalesce(sum(n) OVER (PARTITION BY url ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM lv),
w AS (SELECT m.url, -m.d * 1000000 + m.o * 1000 + generate_subscripts(kw, 1) AS o, unnest(kw) AS w FROM m JOIN inc ON inc.url = m.url AND inc.d = m.d WHERE before < 3
  UNION ALL SELECT url, k * 1000 + generate_subscripts(kw, 1) + 1000000 AS o, unnest(kw) AS w FROM (SELECT url, k, {_sql_keywords("replace(seg, '-', ' ')")} AS kw FROM (SELECT url, generate_subscripts(s, 1) AS k, unnest(s) AS seg FROM p))),
f AS (SELECT url, w, min(o) AS o FROM w WHERE w <> '' GROUP BY url, w)
SELECT p.url, coalesce(string_agg(f.w, ' ' ORDER BY f.o), '') AS keywords FROM p LEFT JOIN f ON f.url = p.url GROUP BY p.url""")
def hub_keywords(spark, d):
    rows = keywords.hub_keywords(table(spark, d, "inventory"), table(spark, d, "hubs"))
    return rows.withColumn("keywords", F.array_join("keywords", " "))


@query()
def inherited_keywords(spark, d):
    """Keywords handed down the links of saved pages, from the pages that no other saved page links to; the pages of rings
    that these don't reach begin too. Hubs give the words of their cards and title, other pages those of their path."""
    pages = table(spark, d, "inventory").where("filename <> '' AND url IS NOT NULL").groupBy("filename").agg(F.min(F.struct("url", "title")).alias("p"))
    saved = pages.select(F.col("filename").alias("key"), U.to_https(F.col("p.url")).alias("url"), "p.title")
    read = materialize(html.outlines(table(spark, d, "rawhtml")))
    saved = materialize(saved.join(html.hubs(read, by_shape=True), "key"))
    found = html.child_links(html.links(read), saved.select("key", "url")).join(saved.select("key", "url"), "key").where("link <> url")
    links = materialize(found.select(F.col("url").alias("parent"), "pos", F.col("link").alias("child")))
    given = F.concat(F.flatten(F.transform("card_headings", lambda c: X.keywords(c))), F.coalesce(X.keywords(X.page_title(F.col("title"))), F.array()))
    hubs = saved.where("is_hub").groupBy("url").agg(F.max(F.array_distinct(given)).alias("cards"))
    own = saved.select("url").union(links.select("child")).distinct().join(hubs, "url", "left").select("url", F.coalesce("cards", X.url_keywords(F.col("url"))).alias("words"))
    own = materialize(own)
    reached = keywords.inherited_keywords(links, saved.select("url").join(links.select(F.col("child").alias("url")), "url", "left_anti"), own)
    rest = keywords.inherited_keywords(links, saved.select("url").join(reached, "url", "left_anti"), own).join(reached, "url", "left_anti")
    return reached.unionByName(rest).select("url", F.col("depth").cast("long").alias("depth"), F.array_join("keywords", " ").alias("keywords"))


_SQL_HEADING_STOP = "[" + ", ".join(f"'{w}'" for w in HEADING_STOP_WORDS) + "]"

# -- documents -----------------------------------------------------------------------------------------------------


@query(rf"""WITH c AS (SELECT DISTINCT id, list_concat(coalesce(keywords, []), list_filter(regexp_split_to_array(replace(lower(coalesce(section_heading, '')), '-', ' '), '@S+'), lambda w: length(w) > 1 AND NOT list_contains({_SQL_HEADING_STOP}, w))) AS k FROM chunks WHERE id IS NOT NULL),
w AS (SELECT id, k, generate_subscripts(k, 1) AS o, unnest(k) AS w FROM c), f AS (SELECT id, k, w, min(o) AS o FROM w GROUP BY id, k, w), g AS (SELECT id, k, string_agg(w, ' ' ORDER BY o) AS words FROM f GROUP BY id, k)
SELECT DISTINCT c.id, coalesce(g.words, '') AS words FROM c LEFT JOIN g ON g.id = c.id AND g.k = c.k""")
def keyword_string(spark, d):
    return table(spark, d, "chunks").where("id IS NOT NULL").select("id", X.keyword_string(F.col("keywords"), F.col("section_heading")).alias("words")).distinct()


@query(r"""SELECT DISTINCT id, CASE WHEN coalesce(heading_prefix, title, '') <> '' THEN coalesce(heading_prefix, title) || chr(10) || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END AS embedded FROM chunks WHERE id IS NOT NULL""")
def embed_text(spark, d):
    return table(spark, d, "chunks").where("id IS NOT NULL").select("id", X.embed_text(F.coalesce("heading_prefix", "title"), F.col("text")).alias("embedded")).distinct()


@query(rf"""WITH last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY crawled_at DESC NULLS LAST) AS r FROM chunks WHERE id IS NOT NULL AND id <> '') WHERE r = 1),
good AS (SELECT * FROM last WHERE length(regexp_replace(coalesce(text, ''), '^@S+|@S+$', '', 'g')) >= 80 AND length(regexp_replace(replace(replace(replace(coalesce(text, ''), 'Skip to main content', ''), 'BEGIN NOINDEX', ''), 'Report webpage issue', ''), '^@S+|@S+$', '', 'g')) >= 60),
k AS (SELECT id, list_concat(coalesce(keywords, []), list_filter(regexp_split_to_array(replace(lower(coalesce(section_heading, '')), '-', ' '), '@S+'), lambda w: length(w) > 1 AND NOT list_contains({_SQL_HEADING_STOP}, w))) AS k FROM good),
f AS (SELECT id, w, min(o) AS o FROM (SELECT id, generate_subscripts(k, 1) AS o, unnest(k) AS w FROM k) GROUP BY id, w), g AS (SELECT id, string_agg(w, ' ' ORDER BY o) AS words FROM f GROUP BY id)
SELECT good.id, coalesce(g.words, '') AS keywords, CASE WHEN coalesce(heading_prefix, title, '') <> '' THEN coalesce(heading_prefix, title) || chr(10) || chr(10) || text ELSE text END AS embed_text, CAST(coalesce(chunk_index, 0) AS BIGINT) AS chunk_index FROM good LEFT JOIN g ON g.id = good.id""")
def validate_docs(spark, d):
    return docs.prepared(docs.latest(table(spark, d, "chunks"))).select("id", "keywords", "embed_text", F.col("chunk_index").cast("long").alias("chunk_index"))


@query(r"""WITH t AS (SELECT coalesce(id, '') <> '' AND length(regexp_replace(coalesce(text, ''), '^@S+|@S+$', '', 'g')) >= 80 AND length(regexp_replace(replace(replace(replace(coalesce(text, ''), 'Skip to main content', ''), 'BEGIN NOINDEX', ''), 'Report webpage issue', ''), '^@S+|@S+$', '', 'g')) >= 60 AS good FROM chunks)
SELECT count(*) AS n_in, count(*) FILTER (WHERE good) AS n_out, count(*) - count(*) FILTER (WHERE good) AS n_skipped FROM t""")
def prep_stats(spark, d):
    return docs.prep_stats(table(spark, d, "chunks"))


# -- search --------------------------------------------------------------------------------------------------------

_SQL_DOCS = r"""docs1 AS (SELECT DISTINCT ON (id) * FROM docs ORDER BY id),
corpus AS (SELECT v.idx, v.vec, d.id, d.title, d.url, d.section_heading, d.text, coalesce(d.keywords, '') || ' ' || lower(coalesce(d.title, '')) AS body,
  trim(coalesce(d.section_heading, '') || ' ' || coalesce(d.title, '')) AS asked FROM docvecs v JOIN docs1 d ON d.id = v.id)"""
_SQL_BM25 = (
    _SQL_DOCS
    + r""",
words AS (SELECT idx, unnest(list_filter(regexp_split_to_array(lower(body), '@S+'), lambda x: x <> '')) AS term FROM corpus),
post AS (SELECT idx, term, count(*) AS tf FROM words GROUP BY idx, term),
len AS (SELECT idx, len(list_filter(regexp_split_to_array(lower(body), '@S+'), lambda x: x <> '')) AS dl FROM corpus),
df AS (SELECT term, count(*) AS n FROM post GROUP BY term),
tot AS (SELECT count(*) AS docs, sum(dl) / greatest(count(*), 1) AS avg_dl FROM len),
q AS (SELECT idx AS qid, term, count(*) AS times FROM (SELECT idx, unnest(list_filter(regexp_split_to_array(lower(asked), '@S+'), lambda x: x <> '')) AS term FROM corpus WHERE idx % 50 = 0) GROUP BY idx, term),
bm AS (SELECT qid, post.idx, round(sum(times * ln((docs - n + 0.5::DOUBLE) / (n + 0.5::DOUBLE) + 1) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avg_dl))), 6) AS bm25_score
  FROM q JOIN post USING (term) JOIN df USING (term) JOIN len ON len.idx = post.idx CROSS JOIN tot GROUP BY qid, post.idx),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY bm25_score DESC, idx) AS rank FROM bm) WHERE rank <= 40)"""
)
_SQL_DENSE = r""",
unit AS (SELECT idx, list_transform(v, lambda x: CAST(CAST(x / n AS FLOAT) AS DOUBLE)) AS u FROM (SELECT idx, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_inner_product(list_transform(vec, lambda x: CAST(x AS DOUBLE)), list_transform(vec, lambda x: CAST(x AS DOUBLE)))) AS n FROM corpus WHERE vec IS NOT NULL AND len(vec) = 64) WHERE n > 0),
de AS (SELECT q.idx AS qid, c.idx, round(list_inner_product(q.u, c.u), 9) AS dense_score FROM unit q, unit c WHERE q.idx % 50 = 0),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dense_score DESC, idx) AS rank FROM de) WHERE rank <= 40)"""
_SQL_RRF = r""",
fused AS (SELECT coalesce(d.qid, s.qid) AS qid, coalesce(d.idx, s.idx) AS idx, dense_score, bm25_score, d.rank AS dr, s.rank AS sr,
  round(coalesce(0.6::DOUBLE / (60 + d.rank), 0) + coalesce(0.4::DOUBLE / (60 + s.rank), 0), 9) AS score
  FROM dense d FULL JOIN sparse s ON d.qid = s.qid AND d.idx = s.idx),
rrf AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, dr NULLS LAST, sr NULLS LAST) AS pos FROM fused)"""


@query(f"WITH {_SQL_BM25} SELECT term, n FROM df")
def bm25_index_stats(spark, d):
    return retrieval.session_index(spark, d).sparse.frequencies


@query(f"WITH {_SQL_BM25} SELECT idx, term, tf FROM post")
def bm25_postings(spark, d):
    return retrieval.session_index(spark, d).sparse.postings.select("idx", "term", "tf")


@query(f"WITH {_SQL_BM25} SELECT qid, idx, bm25_score, rank FROM sparse")
def bm25_search(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    found = sparse.search(asked, corpus.sparse, Settings.from_env().retriever_topk)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_SQL_DOCS}{_SQL_DENSE} SELECT qid, idx, dense_score, rank FROM dense")
def dense_search(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    found = dense.search(asked, corpus.vectors, Settings.from_env().retriever_topk, unique=True, scale=True)
    return found.withColumn("rank", F.col("rank").cast("long"))


@query(r"""SELECT idx, round(list_sum(list_transform(v, lambda x: x / n)), 6) AS total, round(n, 6) AS was FROM (SELECT idx, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_inner_product(list_transform(vec, lambda x: CAST(x AS DOUBLE)), list_transform(vec, lambda x: CAST(x AS DOUBLE)))) AS n FROM docvecs WHERE vec IS NOT NULL) WHERE n > 0""")
def l2_normalize(spark, d):
    rows = dense.normalized(table(spark, d, "docvecs").withColumn("was", F.round(V.length(F.col("vec")), 6)))
    return rows.select("idx", F.round(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "was")


@query(f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF} SELECT qid, idx, score, pos FROM rrf")
def rrf_fusion(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    fused = fusion.reciprocal_rank(*retrieval.legs(asked, corpus, Settings.from_env().retriever_topk))
    return fused.select("qid", "idx", "score", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF} SELECT qid, idx, CASE WHEN count(bm25_score) OVER (PARTITION BY qid) > 0 THEN score ELSE dense_score END AS score FROM rrf")
def hybrid_search(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    return fusion.hybrid(*retrieval.legs(asked, corpus, Settings.from_env().retriever_topk)).select("qid", "idx", "score")


_SQL_ADJUST = r""",
cand AS (SELECT r.qid, r.idx, r.score, r.pos, c.title, c.url, c.section_heading, c.text, q.asked AS query FROM rrf r JOIN corpus c ON c.idx = r.idx JOIN corpus q ON q.idx = r.qid),
shared AS (SELECT *, len(list_distinct(list_intersect(list_filter(regexp_split_to_array(lower(query), '@S+'), lambda x: x <> ''), list_filter(regexp_split_to_array(lower(coalesce(title, '')), '@S+'), lambda x: x <> '')))) AS common,
  len(list_distinct(list_filter(regexp_split_to_array(lower(query), '@S+'), lambda x: x <> ''))) AS many FROM cand),
adj AS (SELECT * EXCLUDE (score, pos), round(score + CASE WHEN common >= 2 THEN 0.003::DOUBLE WHEN common = 1 AND many <= 4 THEN 0.001::DOUBLE ELSE 0 END, 9) AS score, pos AS was FROM shared),
adjusted AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, was) AS pos FROM adj)"""
_SQL_GROUP = r""",
byurl AS (SELECT *, row_number() OVER (PARTITION BY qid, url ORDER BY score DESC, pos) AS n, max(score) OVER (PARTITION BY qid, url) AS top, min(pos) OVER (PARTITION BY qid, url) AS first FROM adjusted),
grouped AS (SELECT * EXCLUDE (pos), row_number() OVER (PARTITION BY qid ORDER BY top DESC, first, url, n) AS pos FROM byurl WHERE n <= 2)"""
_SQL_RERANK = r""",
qw AS (SELECT DISTINCT qid, query, unnest(list_filter(regexp_split_to_array(lower(query), '@S+'), lambda x: x <> '')) AS w FROM grouped),
qi AS (SELECT qid, w, ln((docs - coalesce(n, 0) + 0.5::DOUBLE) / (coalesce(n, 0) + 0.5::DOUBLE) + 1) AS idf FROM qw LEFT JOIN df ON df.term = qw.w CROSS JOIN tot),
there AS (SELECT qid, idx, list_filter(regexp_split_to_array(lower(concat_ws(' ', title, section_heading, text)), '@S+'), lambda x: x <> '') AS ws FROM grouped),
ce AS (SELECT t.qid, t.idx, round(10 * (2 * sum(CASE WHEN list_contains(t.ws, q.w) THEN q.idf ELSE 0 END) / sum(q.idf) - 1), 6) AS ce FROM there t JOIN qi q ON q.qid = t.qid GROUP BY t.qid, t.idx),
pairs AS (SELECT g.*, coalesce(c.ce, 0) AS ce, min(score) OVER (PARTITION BY g.qid) AS lo, max(score) OVER (PARTITION BY g.qid) AS hi FROM grouped g LEFT JOIN ce c ON c.qid = g.qid AND c.idx = g.idx),
rer AS (SELECT * EXCLUDE (pos), round(0.7::DOUBLE * ce + 0.3::DOUBLE * CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE 0.5::DOUBLE END, 9) AS rerank_score, pos AS was2 FROM pairs),
reranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, was2) AS pos FROM rer) WHERE pos <= 15)"""




def _sql_mmr(source: str, rel: str, out: str) -> str:
    """Marginal relevance unrolled: the next pick against all picks so far, five times."""
    steps = [
        f""",
mm AS (SELECT s.qid, s.idx, s.pos, {rel} AS rel, w.u FROM {source} s LEFT JOIN wide w ON w.idx = s.idx),
pick1 AS (SELECT * FROM (SELECT *, 1 AS pick, row_number() OVER (PARTITION BY qid ORDER BY round(rel, 9) DESC, pos) AS k FROM mm) WHERE k = 1)"""
    ]
    so_far = "SELECT * EXCLUDE (k) FROM pick1"
    for n in range(2, 6):
        steps.append(f""",
so{n} AS ({so_far}),
gain{n} AS (SELECT m.qid, m.idx, m.pos, any_value(m.rel) AS rel, any_value(m.u) AS u, {n} AS pick, round(0.3::DOUBLE * any_value(m.rel) - 0.7::DOUBLE * max(coalesce(list_inner_product(m.u, c.u), 0)), 9) AS g
  FROM mm m JOIN so{n} c ON c.qid = m.qid WHERE NOT EXISTS (SELECT 1 FROM so{n} x WHERE x.qid = m.qid AND x.pos = m.pos) GROUP BY m.qid, m.idx, m.pos),
pick{n} AS (SELECT * EXCLUDE (g) FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY g DESC, pos) AS k FROM gain{n}) WHERE k = 1)""")
        so_far += f" UNION ALL SELECT * EXCLUDE (k) FROM pick{n}"
    return "".join(steps) + f", {out} AS ({so_far})"


_SQL_WIDE = r""",
wide AS (SELECT idx, list_transform(v, lambda x: x / n) AS u FROM (SELECT idx, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v, sqrt(list_inner_product(list_transform(vec, lambda x: CAST(x AS DOUBLE)), list_transform(vec, lambda x: CAST(x AS DOUBLE)))) AS n FROM corpus WHERE vec IS NOT NULL AND len(vec) = 64) WHERE n > 0)"""
_SQL_RETRIEVED = (
    f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF}{_SQL_ADJUST}{_SQL_GROUP}{_SQL_RERANK}{_SQL_WIDE}"
    + _sql_mmr("reranked", "s.rerank_score", "picks")
    + """,
found AS (SELECT p.qid, p.pick, p.idx, r.url, r.title, r.section_heading, r.text, r.score, r.rerank_score, d.breadcrumb FROM picks p JOIN reranked r ON r.qid = p.qid AND r.idx = p.idx JOIN corpus c ON c.idx = p.idx JOIN docs1 d ON d.id = c.id),
labelled AS (SELECT c.idx AS qid, c.url, list_filter(regexp_split_to_array(lower(coalesce(c.section_heading, '')), '@S+'), lambda x: x <> '') AS words, 'T' || CAST(CAST(floor(c.idx / 50) AS BIGINT) % 4 + 1 AS VARCHAR) AS tier,
  lower(regexp_extract(c.url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS category FROM corpus c WHERE c.idx % 50 = 0),
seen AS (SELECT l.qid, l.tier, l.category, any_value(l.words) AS words, min(f.pick) FILTER (WHERE contains(lower(f.url), lower(l.url))) AS rank, string_agg(lower(coalesce(f.text, '')), chr(1)) AS texts FROM labelled l LEFT JOIN found f ON f.qid = l.qid GROUP BY l.qid, l.tier, l.category),
ranked AS (SELECT qid, tier, category, rank, rank IS NOT NULL AS hit, coalesce(1.0::DOUBLE / rank, 0) AS mrr, CAST(len(list_filter(words, lambda w: contains(texts, w))) AS DOUBLE) / greatest(len(words), 1) AS kw_recall FROM seen)
"""
)
#: The same pipeline for each request's two sub-queries: its own text, and its keywords with the same vector.
_SQL_SUBQUERIES = """,
asks AS (SELECT 2 * c.idx AS idx, c.asked, c.idx AS vid FROM corpus c WHERE c.idx % 50 = 0 UNION ALL SELECT 2 * c.idx + 1, coalesce(d.keywords, ''), c.idx FROM corpus c JOIN docs1 d ON d.id = c.id WHERE c.idx % 50 = 0)"""
_SQL_MULTI = (
    (
        f"WITH {_SQL_DOCS}{_SQL_SUBQUERIES}{_SQL_BM25.removeprefix(_SQL_DOCS)}{_SQL_DENSE}{_SQL_RRF}{_SQL_ADJUST}{_SQL_GROUP}{_SQL_RERANK}{_SQL_WIDE}"
        + _sql_mmr("reranked", "s.rerank_score", "picks")
    )
    .replace("AS term FROM corpus WHERE idx % 50 = 0", "AS term FROM asks")
    .replace("SELECT q.idx AS qid, c.idx, round", "SELECT a.idx AS qid, c.idx, round")
    .replace("FROM unit q, unit c WHERE q.idx % 50 = 0", "FROM asks a JOIN unit q ON q.idx = a.vid, unit c")
    .replace("JOIN corpus q ON q.idx = r.qid", "JOIN asks q ON q.idx = r.qid")
    + """,
parts AS (SELECT p.qid // 2 AS request, p.qid % 2 AS part, p.pick, p.idx, r.url, r.text, r.rerank_score FROM picks p JOIN reranked r ON r.qid = p.qid AND r.idx = p.idx),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request, url, left(coalesce(text, ''), 100) ORDER BY part, pick) AS n FROM parts) WHERE n = 1)
SELECT request, rank, idx, url, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY rerank_score DESC, part, pick) AS rank FROM once) WHERE rank <= 8"""
)
_SQL_EVIDENCE = """string_agg('[' || pick || '] ' || coalesce(title, '') || CASE WHEN coalesce(section_heading, '') <> '' AND section_heading <> coalesce(title, '') THEN ' — ' || section_heading ELSE '' END || chr(10) || '    URL: ' || coalesce(url, '') || chr(10) || '    ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY pick)"""
_SQL_MEASURES = """count(*) AS n, count(*) FILTER (WHERE hit) AS hits, round(avg(CASE WHEN hit THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit_rate, round(avg(mrr), 6) AS mrr,
 round(avg(CASE WHEN rank <= 1 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r1, round(avg(CASE WHEN rank <= 3 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r3, round(avg(CASE WHEN rank <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS r5, round(avg(kw_recall), 6) AS kw_recall"""


def _candidates(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    return retrieval.candidates(asked, corpus)


def _top(spark, d):
    """The first 15 fused candidates with their vectors."""
    corpus, asked = retrieval.prepared_corpus(spark, d)
    return retrieval.with_vectors(retrieval.candidates(asked, corpus).where("pos <= 15").select("qid", "idx", "score", "pos"), corpus)


@query(f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF}{_SQL_ADJUST} SELECT qid, idx, score, pos FROM adjusted")
def score_adjust(spark, d):
    """By title and by both lists of addresses; the SQL knows only the title, and no address of the given tables is on a list."""
    return fusion.adjusted(_candidates(spark, d), NARROW_PATHS, NARROW_TERMS, BROAD_PATHS).select("qid", "idx", "score", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF}{_SQL_ADJUST}{_SQL_GROUP} SELECT qid, idx, score, pos FROM grouped")
def group_by_url(spark, d):
    return fusion.grouped_by_url(fusion.adjusted(_candidates(spark, d))).select("qid", "idx", "score", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF}{_SQL_ADJUST}{_SQL_GROUP}{_SQL_RERANK} SELECT qid, idx, rerank_score, pos FROM reranked")
def rerank_blend(spark, d):
    rows = fusion.grouped_by_url(fusion.adjusted(_candidates(spark, d)))
    best = fusion.reranked(rows, F.col("pair"))
    return best.select("qid", "idx", "rerank_score", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_SQL_BM25}{_SQL_DENSE}{_SQL_RRF}{_SQL_WIDE}, top AS (SELECT * FROM rrf WHERE pos <= 15)" + _sql_mmr("top", "s.score", "picks") + " SELECT p.qid, p.pick, p.idx, t.score FROM picks p JOIN top t ON t.qid = p.qid AND t.idx = p.idx")
def mmr_select(spark, d):
    return fusion.mmr(_top(spark, d)).select("qid", F.col("pick").cast("long").alias("pick"), "idx", "score")


def _retrieved(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    return corpus, asked, retrieval.retrieve(asked, corpus)


@query(_SQL_RETRIEVED + "SELECT qid, pick, idx, url, title, rerank_score FROM found")
def retrieve_pipeline(spark, d):
    return _retrieved(spark, d)[2].select("qid", F.col("pick").cast("long").alias("pick"), "idx", "url", "title", "rerank_score")


@query(_SQL_MULTI)
def multi_retrieve(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    parts = asked.select(F.col("qid").alias("request"), F.posexplode(F.array(F.col("text"), F.coalesce("keywords", F.lit("")))).alias("part", "text"), "vec")
    rows = retrieval.multi_retrieve(parts, corpus)
    return rows.select("request", F.col("rank").cast("long").alias("rank"), "idx", "url", "rerank_score")


@query(_SQL_RETRIEVED + "SELECT qid, pick AS rank, title, coalesce(section_heading, '') AS section, url, breadcrumb, round(score, 4) AS score, text FROM found")
def search_api(spark, d):
    rows = _retrieved(spark, d)[2]
    return rows.select("qid", F.col("pick").cast("long").alias("rank"), "title", F.coalesce("section_heading", F.lit("")).alias("section"), "url", "breadcrumb", F.round("score", 4).alias("score"), "text")


@query(_SQL_RETRIEVED + "SELECT qid, pick AS rank, count(*) OVER (PARTITION BY qid) AS n, left(coalesce(text, ''), 300) AS preview FROM found")
def diag_api(spark, d):
    rows = _retrieved(spark, d)[2]
    n = F.count(F.lit(1)).over(Window.partitionBy("qid"))
    return rows.select("qid", F.col("pick").cast("long").alias("rank"), n.alias("n"), F.substring(F.coalesce("text", F.lit("")), 1, 300).alias("preview"))


# -- answers -------------------------------------------------------------------------------------------------------


@query(r"""WITH r AS (SELECT user_id, event_id, event_type, props, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id AS conv, 'Recent conversation:' || chr(10) || string_agg(CASE WHEN event_type = 'click' THEN 'User' ELSE 'Assistant' END || ': ' || left(coalesce(props, ''), 300), chr(10) ORDER BY event_id) || chr(10) || chr(10) AS history
FROM r WHERE n >= 2 AND k <= 6 GROUP BY user_id""")
def history_block(spark, d):
    """The event log read as a message log: clicks are the user's turns, all else is the assistant's."""
    log = table(spark, d, "events").select(F.col("user_id").alias("conv"), F.col("event_id").alias("turn"), F.when(F.col("event_type") == "click", "user").otherwise("assistant").alias("role"), F.col("props").alias("content"))
    return answers.history(log)


@query(_SQL_RETRIEVED + f"SELECT qid, {_SQL_EVIDENCE} AS evidence FROM found GROUP BY qid")
def format_evidence(spark, d):
    return answers.evidence(_retrieved(spark, d)[2])


@query(_SQL_RETRIEVED + "SELECT qid, pick AS ref_number, coalesce(title, '') AS title, coalesce(section_heading, '') AS section, coalesce(url, '') AS url, coalesce(breadcrumb, '') AS breadcrumb, left(coalesce(text, ''), 200) AS snippet FROM found")
def build_references(spark, d):
    return answers.references(_retrieved(spark, d)[2])


@query(_SQL_RETRIEVED + f"""SELECT e.qid, CASE WHEN d.keywords IS NOT NULL AND d.keywords <> c.asked THEN '(Underlying need: ' || d.keywords || ')' || chr(10) || chr(10) ELSE '' END || 'Question: ' || c.asked || chr(10) || chr(10) || 'Evidence:' || chr(10) || e.evidence || chr(10) || chr(10) || 'Answer from the evidence and cite sources as [1], [2].' AS prompt
FROM (SELECT qid, {_SQL_EVIDENCE} AS evidence FROM found GROUP BY qid) e JOIN corpus c ON c.idx = e.qid JOIN docs1 d ON d.id = c.id""")
def answer_prompt(spark, d):
    _, asked, found = _retrieved(spark, d)
    rows = asked.select("qid", F.col("text").alias("question"), F.col("keywords").alias("need"), F.lit("").alias("history")).join(answers.evidence(found), "qid")
    return answers.prompts(rows)


@query(_SQL_RETRIEVED + ", last AS (SELECT qid, max(pick) AS n FROM found GROUP BY qid) SELECT f.qid, f.pick AS ref_number, coalesce(f.url, '') AS url FROM found f JOIN last l ON l.qid = f.qid WHERE f.pick = 1 OR f.pick = l.n")
def citations(spark, d):
    """Answers that cite each request's first and last result, the first twice, and numbers that are none of its results."""
    # read for the answers and for their references
    found = materialize(answers.references(_retrieved(spark, d)[2]).select("qid", "ref_number", "url"))
    last = F.max("ref_number").cast("int")
    made = found.groupBy("qid").agg(F.format_string("The fee counts [1], and the note [%d] as well [1]; see neither [%d] nor [0] nor [x].", last, last + 4).alias("answer"))
    return answers.cited(made, found)


@query(r"""WITH a AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 2 = 0 THEN 'Assistant: ' ELSE 'ASSISTANT:  ' END ELSE '' END || text || CASE WHEN doc_id % 4 = 0 THEN repeat(chr(10), 4) || 'Keep the records. ' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN ' Ask a Professional.' ELSE '' END AS said FROM documents WHERE text IS NOT NULL)
SELECT doc_id, regexp_replace(regexp_replace(CASE WHEN doc_id % 3 = 0 THEN regexp_replace(substr(said, 11), '^\s+', '') ELSE regexp_replace(said, '^Assistant:\s*', '', 'i') END, '\n{3,}', chr(10) || chr(10), 'g'), '^@S+|@S+$', '', 'g')
 || CASE WHEN contains(lower(said), 'general information') OR contains(lower(said), 'professional') THEN '' ELSE chr(10) || chr(10) || 'This is general information only.' END AS answer FROM a""")
def clean_answer(spark, d):
    """Answers made of the documents, some with the speaker's name before, surplus line breaks, or a word of advice."""
    n = F.col("doc_id")
    name = F.when((n % 3 == 0) & (n % 2 == 0), "Assistant: ").when(n % 3 == 0, "ASSISTANT:  ").otherwise("")
    said = F.concat(name, F.col("text"), F.when(n % 4 == 0, "\n\n\n\nKeep the records. ").otherwise(""), F.when(n % 5 == 0, " Ask a Professional.").otherwise(""))
    rows = table(spark, d, "documents").where("text IS NOT NULL")
    return rows.select("doc_id", X.with_disclaimer(X.clean_answer(said), DISCLAIMER).alias("answer"))


@query(r"""SELECT event_id, CASE WHEN event_id % 5 IN (0, 1) THEN 'ask_' || event_type ELSE 'question' END AS intent,
 CASE WHEN event_id % 5 IN (0, 3) THEN 'need of ' || user_id ELSE event_type END AS need,
 CASE WHEN event_id % 5 = 0 THEN event_type || ' first' ELSE event_type END AS first_query, CASE WHEN event_id % 5 = 0 THEN 3 ELSE 1 END AS queries FROM events""")
def parse_understanding(spark, d):
    """Replies made of the event log: whole ones in a fence, ones without queries or with none, plain words, and nulls.
    What is missing falls back on the query, field by field."""
    rows = table(spark, d, "events")
    kind, asked = F.col("event_id") % 5, F.col("event_type")
    named = F.concat(F.lit("ask_"), asked).alias("intent")
    need = F.concat(F.lit("need of "), F.col("user_id").cast("string")).alias("understood_need")
    four = F.array(*(F.concat(asked, F.lit(f" {k}")) for k in ("first", "second", "third", "fourth"))).alias("search_queries")
    whole = F.concat(F.lit("```json\n"), F.to_json(F.struct(named, need, four)), F.lit("\n```"))
    empty = F.to_json(F.struct(need, F.array().cast("array<string>").alias("search_queries")))
    reply = F.when(kind == 0, whole).when(kind == 1, F.to_json(F.struct(named))).when(kind == 2, F.concat(F.lit("I cannot say. "), asked)).when(kind == 3, empty)
    u = rows.select("event_id", answers.understood(reply, asked).alias("u"))
    return u.select("event_id", F.col("u.intent").alias("intent"), F.col("u.understood_need").alias("need"), F.get("u.search_queries", F.lit(0)).alias("first_query"), F.size("u.search_queries").alias("queries"))


@query(r"""SELECT inv_id, coalesce(length(title) BETWEEN 1 AND 500, false) AS valid FROM inventory""")
def validate_query(spark, d):
    return table(spark, d, "inventory").select("inv_id", answers.valid_query(F.col("title")).alias("valid"))


# -- evaluation ----------------------------------------------------------------------------------------------------


def _questions(corpus):
    """Known items as labelled questions: the page's own address is expected, its heading's words are to be found."""
    return corpus.where("idx % 50 = 0").select(
        F.col("idx").alias("qid"),
        F.array("url").alias("fragments"),
        X.words(F.lower(F.coalesce("section_heading", F.lit("")))).alias("answer_words"),
        F.concat(F.lit("T"), (F.floor(F.col("idx") / 50) % 4 + 1).cast("string")).alias("tier"),
        site_of(F.col("url")).alias("category"),
    )


def _ranked(spark, d):
    corpus, _, found = _retrieved(spark, d)
    return evaluation.ranks(_questions(corpus.docs), found)


@query(_SQL_RETRIEVED + "SELECT qid, tier, category, coalesce(rank, 0) AS rank, hit, round(mrr, 6) AS mrr FROM ranked")
def eval_rank(spark, d):
    return _ranked(spark, d).select("qid", "tier", "category", F.coalesce("rank", F.lit(0)).alias("rank"), "hit", F.round("mrr", 6).alias("mrr"))


@query(_SQL_RETRIEVED + "SELECT qid, round(kw_recall, 6) AS kw_recall FROM ranked")
def eval_keyword_recall(spark, d):
    return _ranked(spark, d).select("qid", F.round("kw_recall", 6).alias("kw_recall"))


@query(_SQL_RETRIEVED + f"SELECT {_SQL_MEASURES} FROM ranked")
def eval_metrics(spark, d):
    return evaluation.metrics(_ranked(spark, d))


@query(_SQL_RETRIEVED + f"SELECT tier, category, {_SQL_MEASURES} FROM ranked GROUP BY GROUPING SETS ((), (tier), (category))")
def eval_by_group(spark, d):
    return evaluation.by_group(_ranked(spark, d))


@query(_SQL_RETRIEVED + "SELECT qid, tier, category FROM ranked WHERE NOT hit")
def eval_failed(spark, d):
    return _ranked(spark, d).where("NOT hit").select("qid", "tier", "category")


@query(_SQL_RETRIEVED + """, legs AS (SELECT 'dense' AS search, qid, idx, dense_score AS score, rank AS pos FROM dense UNION ALL SELECT 'bm25', qid, idx, bm25_score, rank FROM sparse
 UNION ALL SELECT 'hybrid', qid, idx, CASE WHEN count(bm25_score) OVER (PARTITION BY qid) > 0 THEN score ELSE dense_score END, pos FROM rrf),
lu AS (SELECT l.*, c.url, row_number() OVER (PARTITION BY search, qid, c.url ORDER BY score DESC, pos) AS n, max(score) OVER (PARTITION BY search, qid, c.url) AS top, min(pos) OVER (PARTITION BY search, qid, c.url) AS first FROM legs l JOIN corpus c ON c.idx = l.idx),
lg AS (SELECT *, row_number() OVER (PARTITION BY search, qid ORDER BY top DESC, first, url, n) AS k FROM lu WHERE n <= 2),
lr AS (SELECT s.search, l.qid, min(g.k) FILTER (WHERE contains(lower(g.url), lower(l.url))) AS rank FROM labelled l CROSS JOIN (SELECT DISTINCT search FROM legs) s LEFT JOIN lg g ON g.qid = l.qid AND g.search = s.search AND g.k <= 5 GROUP BY s.search, l.qid)
SELECT search, count(*) FILTER (WHERE rank IS NOT NULL) AS hits, count(*) AS total, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 3) AS mrr FROM lr GROUP BY search""")
def eval_compare_search(spark, d):
    corpus, asked = retrieval.prepared_corpus(spark, d)
    k = Settings.from_env().retriever_topk
    # each leg is read by two of the three searches
    dn, sp = map(materialize, retrieval.legs(asked, corpus, k))
    fields = corpus.docs.select("idx", "url", "text")
    found = None
    for name, rows in (("dense", dn.withColumn("score", F.col("dense_score")).withColumn("pos", F.col("rank"))), ("bm25", sp.withColumn("score", F.col("bm25_score")).withColumn("pos", F.col("rank"))), ("hybrid", fusion.hybrid(dn, sp))):
        top = fusion.grouped_by_url(rows.select("qid", "idx", "score", "pos").join(fields, "idx")).where("pos <= 5")
        one = evaluation.ranks(_questions(corpus.docs), top, "pos").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"), F.round(F.avg("mrr"), 3).alias("mrr")).select(F.lit(name).alias("search"), "hits", "total", "mrr")
        found = one if found is None else found.unionByName(one)
    return found


@query(_SQL_RETRIEVED + "SELECT tier, count(*) AS n, round(avg(g), 6) AS mean, count(*) FILTER (WHERE g = 2) AS perfect, count(*) FILTER (WHERE g = 0) AS failed FROM (SELECT tier, CASE WHEN rank = 1 THEN 2 WHEN hit THEN 1 ELSE 0 END AS g FROM ranked) GROUP BY tier")
def grade_summary(spark, d):
    rows = _ranked(spark, d).withColumn("grade", F.when(F.col("rank") == 1, 2).when(F.col("hit"), 1).otherwise(0))
    return evaluation.graded(rows, "tier", "grade")


@query(r"""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS avg_value, max(value) FILTER (WHERE k = CAST(floor(n * 0.95::DOUBLE) AS BIGINT)) AS p95_value FROM r GROUP BY event_type""")
def latency_p95(spark, d):
    return evaluation.latency(table(spark, d, "events"), "event_type", "value", "event_id")


@query("SELECT count(*) AS requests, count(*) FILTER (WHERE event_type = 'error') AS errors, count(DISTINCT user_id) AS users FROM events")
def health_counters(spark, d):
    return table(spark, d, "events").agg(F.count(F.lit(1)).alias("requests"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_distinct("user_id").alias("users"))


# -- inventory -----------------------------------------------------------------------------------------------------


@query("SELECT inv_id, url FROM inventory WHERE coalesce(filename, '') = ''")
def failed_pages(spark, d):
    return inventory.failed(table(spark, d, "inventory")).select("inv_id", "url")


@query(r"""WITH last AS (SELECT url, status, title, filename, size FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC NULLS LAST, inv_id DESC) AS k FROM inventory WHERE coalesce(filename, '') <> '' AND url IS NOT NULL) WHERE k = 1)
SELECT i.inv_id, i.url, coalesce(CASE WHEN l.url IS NULL THEN i.status ELSE l.status END, -1) AS status, CASE WHEN l.url IS NULL THEN i.filename ELSE l.filename END AS filename FROM inventory i LEFT JOIN last l ON i.url = l.url""")
def inventory_merge(spark, d):
    rows = table(spark, d, "inventory")
    return inventory.merged(rows, rows).select("inv_id", "url", F.coalesce("status", F.lit(-1)).alias("status"), "filename")


@query(r"""SELECT CASE WHEN coalesce(i.filename, '') = '' THEN CASE WHEN lower(trim(coalesce(title, ''))) = 'access denied' THEN 'blocked' ELSE 'fetch-error' END
 WHEN h.url IS NOT NULL THEN 'hub' WHEN i.inv_id > f.first THEN 'leaf-dup' WHEN c.url IS NOT NULL THEN 'leaf' ELSE 'leaf-empty' END AS type, count(*) AS n
FROM inventory i LEFT JOIN (SELECT DISTINCT url FROM hubs) h ON h.url = i.url LEFT JOIN (SELECT DISTINCT url FROM chunks) c ON c.url = i.url
LEFT JOIN (SELECT url, min(inv_id) AS first FROM inventory WHERE filename <> '' GROUP BY url) f ON f.url = i.url GROUP BY 1""")
def page_type_counts(spark, d):
    return inventory.page_types(table(spark, d, "inventory"), table(spark, d, "hubs"), table(spark, d, "chunks"))


@query(r"""SELECT filename, 'page' AS came_from FROM rawhtml UNION ALL SELECT DISTINCT filename, 'inventory' FROM inventory WHERE filename <> '' AND filename NOT IN (SELECT filename FROM rawhtml WHERE filename IS NOT NULL)""")
def corpus_union(spark, d):
    pages = table(spark, d, "rawhtml").select("filename", F.lit("page").alias("came_from"))
    more = table(spark, d, "inventory").where("filename <> ''").select("filename", F.lit("inventory").alias("came_from")).distinct()
    return inventory.added_files(pages, more)
