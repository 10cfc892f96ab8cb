"""Text expressions: clean-up, counting, keywords, sentences, identifiers. Column in, Column out."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexmill.config import BOILERPLATE, HEADING_STOP_WORDS, LAST_UPDATED, PREP_BOILERPLATE, QUICK_CODE, STOP_WORDS

#: Full-width forms U+FF01 to U+FF5E stand 0xFEE0 above their ASCII characters.
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))
_INVISIBLE = "[\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF\\u00AD]"
#: Beyond ASCII first, which one comparison tells.
_ODD = "[^\\x00-\\x7F](?<=[\\uFF01-\\uFF5E\\u3000\\u200B-\\u200F\\u202A-\\u202E\\u2060\\uFEFF\\u00AD\\u00A0\\u2007\\u202F])"


def fold_text(text: Column) -> Column:
    """Full-width characters made narrow, invisible ones dropped, no-break spaces made plain.

    Texts without such characters, nearly all, pass through one scan only.
    """
    narrow = F.translate(text, _WIDE, _NARROW)
    folded = F.regexp_replace(F.regexp_replace(narrow, _INVISIBLE, ""), "[\\u00A0\\u2007\\u202F\\u3000]", " ")
    return F.when(F.rlike(text, F.lit(_ODD)), folded).otherwise(text)


def spaces(text: Column) -> Column:
    """Unicode white space taken off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


@F.pandas_udf(T.StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Unicode compatibility composition; Spark has no such expression."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def squeezed(text: Column) -> Column:
    """Invisible marks dropped, runs of blanks (not line breaks) to one space, ends trimmed."""
    bare = F.regexp_replace(F.replace(text, F.lit("\u00a0"), F.lit(" ")), "[\\u200B-\\u200F\\u202A-\\u202E]", "")
    return spaces(F.regexp_replace(bare, r"[ \t\r\f\x0B]+", " "))


def norm(text: Column) -> Column:
    """Compatibility form with blanks squeezed. Only texts beyond ASCII go through Python."""
    return squeezed(F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), nfkc(text)).otherwise(text))


def without_boilerplate(text: Column, markers: list[str] | None = None) -> Column:
    """Page markers, quick codes and update notices deleted, three or more line breaks made two."""
    for marker in BOILERPLATE if markers is None else markers:
        text = F.replace(text, F.lit(marker), F.lit(""))
    for pattern in (QUICK_CODE, LAST_UPDATED):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def clean_text(text: Column) -> Column:
    return norm(without_boilerplate(text))


def words(text: Column) -> Column:
    """Words between white space; none for an empty text."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def token_count(text: Column) -> Column:
    """About 1.3 tokens for each word, rounded down."""
    return F.floor(F.size(words(text)) * F.lit(1.3)).cast("int")


def keywords(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case words of letters, digits and hyphens, without stop words and single characters."""
    banned = F.array(*[F.lit(w) for w in (STOP_WORDS if stop is None else stop)])
    bare = F.regexp_replace(F.lower(text), r"[^a-zA-Z0-9\s-]", " ")
    return F.filter(F.split(bare, r"\s+"), lambda w: (F.length(w) > 1) & ~F.array_contains(banned, w))


def url_keywords(url: Column) -> Column:
    """Keywords of the path's segments, first occurrences in order."""
    from lexmill.functions.urls import segments

    return F.array_distinct(F.flatten(F.transform(segments(url), lambda s: keywords(F.replace(s, F.lit("-"), F.lit(" "))))))


def page_title(title: Column) -> Column:
    """A page's title without what follows the first bar."""
    return spaces(F.regexp_replace(title, r"\s*\|.*$", ""))


def heading_prefix(title: Column, heading: Column) -> Column:
    return F.when((F.coalesce(heading, F.lit("")) != "") & (heading != title), F.concat(title, F.lit(" — "), heading)).otherwise(title)


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark and white space."""
    return F.split(text, r"(?U)(?<=[.!?])\s+")


def chunk_id(url: Column, index: Column) -> Column:
    """Ten digits of the address's hash and the chunk's number from 1."""
    return F.concat(F.substring(F.sha1(url), 1, 10), F.lit("_"), F.format_string("%03d", index + 1))


def keyword_string(words_of: Column, heading: Column) -> Column:
    """Keywords and the heading's words without stop words, first occurrences in order, joined by spaces."""
    banned = F.array(*[F.lit(w) for w in HEADING_STOP_WORDS])
    parts = words(F.replace(F.lower(F.coalesce(heading, F.lit(""))), F.lit("-"), F.lit(" ")))
    kept = F.filter(parts, lambda w: (F.length(w) > 1) & ~F.array_contains(banned, w))
    return F.array_join(F.array_distinct(F.concat(F.coalesce(words_of, F.array()), kept)), " ")


def embed_text(prefix: Column, text: Column) -> Column:
    """Heading context, an empty line and the text; the text alone without context."""
    return F.when(F.coalesce(prefix, F.lit("")) != "", F.concat(prefix, F.lit("\n\n"), F.coalesce(text, F.lit("")))).otherwise(F.coalesce(text, F.lit("")))


def is_valid_text(text: Column) -> Column:
    """At least 80 characters, and 60 without page markers, ends trimmed."""
    bare = text
    for marker in PREP_BOILERPLATE:
        bare = F.replace(bare, F.lit(marker), F.lit(""))
    return F.coalesce((F.length(spaces(text)) >= 80) & (F.length(spaces(bare)) >= 60), F.lit(False))


def clean_answer(text: Column) -> Column:
    """An answer without the speaker's name and surplus line breaks; empty for null."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?i)^Assistant:\s*", "")
    return spaces(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def without_fence(text: Column) -> Column:
    """JSON out of a fenced block, fences taken off."""
    bare = spaces(text)
    bare = F.when(bare.startswith("```") & F.contains(bare, F.lit("\n")), F.regexp_replace(bare, r"^[^\n]*\n", "")).otherwise(F.regexp_replace(bare, "^```", ""))
    return spaces(F.regexp_replace(bare, "```$", ""))


def with_disclaimer(answer: Column, disclaimer: str) -> Column:
    """The answer with the notice below it, unless it already points to general information or professionals."""
    low = F.lower(answer)
    there = F.contains(low, F.lit("general information")) | F.contains(low, F.lit("professional"))
    return F.when(there, answer).otherwise(F.concat(answer, F.lit("\n\n" + disclaimer)))


def citations(answer: Column) -> Column:
    """Numbers cited as [n], in order, repeats included."""
    return F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda x: x.cast("int"))
