"""Registered queries of the numbered problems and the SQL that some of them are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexmill.llm import line_repeats, main_body, mixing, near_duplicates, packing, residue, splitting, subjects, vector_neighbors
from lexmill.llm.tokens import token_counts
from lexmill.session import materialize
from lexmill.sources.tables import table


def p1_found(spark, d):
    return residue.residue_found(table(spark, d, "inventory"), table(spark, d, "chunks"))


#: What TESTDATA.md calls nearly the same: three words, 0.7, at least 30 words.
NEAR = {"threshold": 0.7, "shingle": 3, "min_words": 30}


def p2_found(spark, d):
    return near_duplicates.similar_pairs(table(spark, d, "chunks"), **NEAR).select("id_a", "id_b")


def p2_groups(spark, d):
    return near_duplicates.near_duplicate_groups(table(spark, d, "chunks"), **NEAR)


def p3_found(spark, d):
    return splitting.cut_places(table(spark, d, "chunks"))


def p3_pieces(spark, d):
    pieces = splitting.split_oversized(table(spark, d, "chunks"))
    return pieces.select("id", "piece", "pieces", "word_from", "section_heading", "text", "chunk_index", "chunk_total")


def p4_found(spark, d):
    return vector_neighbors.close_pairs(table(spark, d, "docvecs"))


def p4_neighbors(spark, d):
    """Ten nearest for every row whose idx is divisible by 50, against all rows."""
    found = vector_neighbors.nearest(table(spark, d, "docvecs"), is_query=F.col("idx") % 50 == 0, tables=8, depth=1, probes=8)
    return found.select(F.col("a").alias("idx_a"), F.col("b").alias("idx_b"), F.col("rank").cast("long").alias("rank"), F.round("cosine", 6).alias("cosine"))


def p5_found(spark, d):
    return line_repeats.repeated_lines(table(spark, d, "chunks"))


def p5_sequences(spark, d):
    return line_repeats.frequent_sequences(table(spark, d, "chunks"))


def p5_clean(spark, d):
    clean = line_repeats.without_repeated_lines(table(spark, d, "chunks"))
    return clean.select("id", "text_clean", "lines_removed").distinct()


def p6_found(spark, d):
    return main_body.outside_main_body(table(spark, d, "chunks"), table(spark, d, "rawhtml"))


def p6_text(spark, d):
    return main_body.main_body(table(spark, d, "chunks"), table(spark, d, "rawhtml"))


def p7_pack(spark, d):
    return packing.pack(materialize(token_counts(table(spark, d, "documents"))), table(spark, d, "capacities"))


def p7_fill(spark, d):
    return packing.fill_report(p7_pack(spark, d))


def p8_mix(spark, d):
    sizes = materialize(token_counts(table(spark, d, "documents"), keep=("source",)))
    return mixing.mix(sizes, table(spark, d, "mix_targets"))


def p8_shares(spark, d):
    return mixing.share_report(p8_mix(spark, d), table(spark, d, "mix_targets"))


def p9_found(spark, d):
    found = subjects.subjects_of(table(spark, d, "documents"), table(spark, d, "chunks"), table(spark, d, "subjects"), table(spark, d, "subject_labels"))
    return found.select("doc_id", "subject")


QUERIES = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_pieces": p3_pieces,
    "p4_found": p4_found,
    "p4_neighbors": p4_neighbors,
    "p5_found": p5_found, "p5_sequences": p5_sequences, "p5_clean": p5_clean,
    "p6_found": p6_found,
    "p6_text": p6_text,
    "p7_pack": p7_pack,
    "p7_fill": p7_fill,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p9_found": p9_found,
}

_LINES = r"""
lines AS (
  SELECT DISTINCT id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) AS site,
         line_no, regexp_replace(regexp_replace(lower(line), '[0-9]+', '0', 'g'), '[^a-z0-9]+', '', 'g') AS form
  FROM (SELECT id, url, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM chunks WHERE text IS NOT NULL AND id IS NOT NULL)),
often AS (
  SELECT site, form FROM lines WHERE form <> '' AND site <> '' GROUP BY site, form HAVING count(DISTINCT url) >= 5),
found AS (
  SELECT DISTINCT l.id, CAST(l.line_no AS INTEGER) AS line_no FROM lines l JOIN often o ON l.site = o.site AND l.form = o.form)
"""

ORACLES = {
    "p2_found": r"""WITH texts AS (
  SELECT DISTINCT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || text), '[a-z0-9]+') AS w FROM chunks
  WHERE id IS NOT NULL AND len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 30),
runs AS (
  SELECT DISTINCT id, s FROM (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS s FROM texts)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
both_of AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS n FROM runs a JOIN runs b ON a.s = b.s AND a.id < b.id GROUP BY a.id, b.id)
SELECT id_a, id_b FROM both_of JOIN sizes x ON x.id = id_a JOIN sizes y ON y.id = id_b
WHERE both_of.n >= 0.7 * (x.n + y.n - both_of.n)""",
    "p2_groups": r"""WITH RECURSIVE texts AS (
  SELECT DISTINCT id, regexp_extract_all(lower(coalesce(title, '') || ' ' || text), '[a-z0-9]+') AS w FROM chunks
  WHERE id IS NOT NULL AND len(regexp_extract_all(lower(text), '[a-z0-9]+')) >= 30),
classes AS (SELECT id, min(id) OVER (PARTITION BY w) AS class_id, w FROM texts),
runs AS (
  SELECT DISTINCT id, s FROM (SELECT id, unnest(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) AS s FROM classes WHERE id = class_id)),
sizes AS (SELECT id, count(*) AS n FROM runs GROUP BY id),
both_of AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM runs a JOIN runs b ON a.s = b.s AND a.id <> b.id GROUP BY a.id, b.id),
linked AS (SELECT a, b FROM both_of JOIN sizes x ON x.id = a JOIN sizes y ON y.id = b WHERE both_of.n >= 0.7 * (x.n + y.n - both_of.n)),
reach(a, b) AS (SELECT class_id, class_id FROM classes UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
groups AS (SELECT a, min(b) AS group_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS links FROM linked GROUP BY a)
SELECT e.id, c.class_id, g.group_id, coalesce(d.links, 0) AS links
FROM (SELECT DISTINCT id FROM chunks WHERE id IS NOT NULL) e LEFT JOIN classes c ON c.id = e.id LEFT JOIN groups g ON g.a = c.class_id LEFT JOIN degree d ON d.a = c.class_id""",
    "p4_found": r"""WITH v AS (
  SELECT DISTINCT idx, list_transform(vec, lambda x: CAST(x AS DOUBLE)) AS v FROM docvecs WHERE vec IS NOT NULL AND len(vec) = 64),
u AS (SELECT idx, v, sqrt(list_inner_product(v, v)) AS n FROM v WHERE list_inner_product(v, v) > 0),
c AS (SELECT a.idx AS a, b.idx AS b, list_inner_product(a.v, b.v) / (a.n * b.n) AS cosine FROM u a JOIN u b ON a.idx <> b.idx),
r AS (SELECT a, b, cosine, row_number() OVER (PARTITION BY a ORDER BY round(cosine, 9) DESC, b) AS k FROM c)
SELECT DISTINCT least(a, b) AS idx_a, greatest(a, b) AS idx_b FROM r WHERE k <= 10 AND cosine >= 0.9""",
    "p5_found": f"WITH {_LINES} SELECT id, line_no FROM found",
    # every subsequence of each chunk's frequent lines, grown from its leftmost place; then those that are closed
    "p5_sequences": f"""WITH RECURSIVE {_LINES},
seqs AS (
  SELECT id, l.url, l.site, l.form, line_no, row_number() OVER (PARTITION BY id, l.url ORDER BY line_no) AS pos
  FROM (SELECT DISTINCT id, url, site, form, line_no FROM lines) l JOIN often o ON l.site = o.site AND l.form = o.form),
step AS (
  SELECT a.id, a.url, a.pos AS start, s.form, min(s.pos) AS pos, arg_min(s.line_no, s.pos) AS line_no
  FROM (SELECT DISTINCT id, url, pos FROM seqs UNION SELECT DISTINCT id, url, 0 FROM seqs) a JOIN seqs s ON s.id = a.id AND s.url = a.url AND s.pos > a.pos
  GROUP BY a.id, a.url, a.pos, s.form),
grown(id, url, forms, nos, pos) AS (
  SELECT id, url, [form], [line_no], pos FROM step WHERE start = 0
  UNION ALL
  SELECT g.id, g.url, list_append(g.forms, s.form), list_append(g.nos, s.line_no), s.pos FROM grown g JOIN step s ON s.id = g.id AND s.url = g.url AND s.start = g.pos),
sup AS (
  SELECT s.site, g.forms, count(DISTINCT g.url) AS pages, count(*) AS docs, min({{'id': g.id, 'nos': g.nos}}) AS first
  FROM grown g JOIN (SELECT DISTINCT id, url, site FROM seqs) s ON s.id = g.id AND s.url = g.url GROUP BY s.site, g.forms HAVING count(DISTINCT g.url) >= 5),
longer AS (
  SELECT DISTINCT site, list_concat(forms[1:k - 1], forms[k + 1:]) AS forms, docs FROM (SELECT site, forms, docs, unnest(range(1, len(forms) + 1)) AS k FROM sup))
SELECT site, CAST(len(forms) AS BIGINT) AS length, pages, docs, first.id AS example_id, array_to_string(first.nos, ',') AS example_lines
FROM sup ANTI JOIN longer USING (site, forms, docs)""",
    "p5_clean": f"""WITH {_LINES},
kept AS (
  SELECT c.id, c.text, c.line, c.line_no, f.id IS NULL AS stays
  FROM (SELECT DISTINCT id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no
        FROM chunks WHERE text IS NOT NULL) c
  LEFT JOIN found f ON f.id = c.id AND f.line_no = c.line_no)
SELECT id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE stays), '') AS text_clean,
       count(*) FILTER (WHERE NOT stays) AS lines_removed
FROM kept GROUP BY id, text
UNION ALL SELECT DISTINCT id, NULL, 0 FROM chunks WHERE text IS NULL""",
}
