"""Template residue, filler text and error pages.

Placeholders are found by one small grammar for each delimiter: what stands between the delimiters must be
a field name, or an expression in the delimiters of template languages, not prose. Filler and error messages are found
by their phrases, filler Latin by its word endings and its want of function words. Code blocks,
inline code and quoted words are left out before, since guidance quotes messages and shows templates; a
sentence that explains templates, formulas or labels is discounted, and a text in which such sentences
outnumber the plain ones is taken for a tutorial.

Everything is one pass of JVM expressions over the texts: a cheap test with the same grammars picks the few
texts on which context is looked at. Nothing is shuffled but the keys of the hits.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import fold_text

#: A field name: identifier parts joined by dots, hyphens or one space.
NAME = r"[A-Za-z0-9_][A-Za-z0-9_.\-]*+"
FIELD = rf"{NAME}(?:\s{NAME})?"
#: An expression of a template language: names and quoted values, then filters or operators with theirs. Since
#: quoted words are taken out of a text before its context is looked at, an operator may be left without its value.
VALUE = rf"(?:{NAME}|'[^'\n]*'|\"[^\"\n]*\")"
EXPRESSION = rf"{NAME}(?:\[{VALUE}\]|\({VALUE}?\))*(?:\s?(?:[|:,?+*/=!<>-]{{1,3}}\s?)?{VALUE})*(?:\s?[|:,=<>]{{1,3}})?"

#: The grammar of each delimiter pair.
DELIMITED = [
    rf"\{{\{{[-~#/^>&]?\s?{EXPRESSION}\s?[-~]?\}}\}}",
    rf"\{{%[-+]?\s?{EXPRESSION}\s?[-+]?%\}}",
    rf"<%[=-]?\s?{EXPRESSION}\s?-?%>",
    rf"[$#]\{{\s?{EXPRESSION}\s?\}}",
    rf"\{{{FIELD}\}}",
    rf"\[\[\s?{FIELD}\s?\]\]",
    r"(?i:\[(?:insert|enter|add|your)\s[^\[\]\n]{1,60}\])",
    r"(?i:\[[^\[\]\n]{1,50}\s-\s(?:tbc|tbd|tba)\])",
    r"(?i:\[object\sobject\])",
    r"(?i:\[editor:)",
    rf"<<\s?{FIELD}\s?>>",
    rf"«{FIELD}»",
    r"(?i:<(?:enter|insert|your)\s[^<>\n]{1,60}>)",
    r"(?i:<[^<>\n]{1,60}\sgoes\shere>)",
    rf"%%{FIELD}%%",
    rf"@@{FIELD}@@",
    r"__(?:[A-Za-z0-9][A-Za-z0-9_.\-]*?(?:\s[A-Za-z0-9][A-Za-z0-9_.\-]*?)?)?__",
    rf"#[A-Za-z][A-Za-z0-9_.\-]*+(?:\s{NAME})?#",
    r"(?i:#(?:ref!|n/a|name\?|value!|div/0!))",
    r"(?i:\$x(?:,xxx)+\b)",
    r"(?<![\w%])%[sd]\b",
]
#: Values that a template printed for want of a field, and masks that nobody filled in.
UNSET = [
    r"(?i:(?:undefined|nan)\b(?<=\b(?:by|to|is|until|dear|contact|at|of|for)\s(?:undefined|nan)))",
    r"NaN\b",
    r"(?i:null\snull\b)",
    r"(?i:tbc\stbc\b)",
    r"(?i:xx/xx/xxxx\b)",
    r"NN?/NN?/NNNN\b",
]
#: Notes to whoever was to write the text.
FILLER = [
    r"lorem\sipsum\b",
    r"(?:add|write|insert)\s(?:\w+\s){1,4}(?:sentences?|paragraphs?|words)\s(?:about|on)\b.{1,120}?\shere\b",
    r"draft\s(?:text|copy)\b.{0,12}copy\sto\scome\b",
    r"(?:copy|text|wording|content)\sto\s(?:come|follow)\sfrom\b",
    r"todo:?\s(?:confirm|add|check|write|replace|fix|insert|update|remove)\b",
    r"your\s(?:heading|title|text|copy|content)\s(?:goes\s)?here\b",
    r"(?:placeholder|dummy|filler)\s(?:paragraph|sentence|text|copy|content)\b",
    r"to\s(?:supply|provide|send|confirm|write)\s(?:the\s)?(?:wording|copy|text)\b",
    r"(?:replace|rewrite|delete)\sthis\s(?:paragraph|sentence|text|section|placeholder)\b",
    r"(?:heading|text|title|content|copy)\sgoes\shere\b",
]
SCRIPTS = [
    r"(?:enable|activate|switch\son|turn\son)\sjavascript\b",
    r"javascript\s(?:is|must\sbe)\s(?:not\savailable|disabled|required|enabled|switched\soff|turned\soff)\b",
    r"(?:page|site)\s(?:requires|needs)\s(?:java)?scripts?\b",
    r"scripts\s(?:must\sbe\s)?(?:switched|turned)\son\b",
    r"(?:veuillez\s)?activer\sjavascript\b",
    r"aktivieren\ssie\sjavascript\b",
    r"(?:active|activa|habilite)\sjavascript\spara\b",
]
ERRORS = [
    r"http\serror\s[45]\d\d\b",
    r"[45]\d\d\s[-–]\swe\scould\snot\sfind\b",
    r"(?:bad\sgateway|gateway\stime-?out|page\snot\sfound|access\sdenied|forbidden)\.(?:\s|$)",
    r"upstream\s(?:host|server)\s(?:did\snot|failed\sto)\s(?:reply|respond|answer)\b",
    r"the\sservice\sis\s(?:temporarily\s)?unavailable\b",
    r"internal\sserver\serror:",
    r"warning:\s\w+\(\):",
    r"template\s\S+\s(?:is\s)?(?:missing|not\sfound)\b",
    r"(?:cannot|could\snot|failed\sto|unable\sto)\srender\s(?:the\s)?(?:body|page|template|view|block)\b",
    r"down\sfor\smaintenance\b",
    r"too\smany\srequests\sfrom\b",
    r"are\syou\sa\srobot\?",
    r"complete\sthe\scheck\b.{0,80}?\sto\s(?:go\son|continue)\b",
    r"checking\syour\sbrowser\s",
    r"your\ssession\b.{0,80}?\shas\s(?:expired|timed\sout)\b",
    r"sign\sin\sagain\sto\scontinue\b",
    r"something\swent\swrong\swhile\s",
    r"may\shave\sbeen\s(?:moved|removed|deleted)\sor\s(?:withdrawn|renamed|moved|removed)\b",
    r"you\sdo\snot\shave\spermission\sto\s(?:view|access)\b",
    r"(?:address|page|document)\s/\S*\s(?:does\snot\sexist|is\sno\slonger\savailable|was\snot\sfound)\b",
    r"seite\snicht\sgefunden\s?:",
    r"page\sintrouvable\s?:",
    r"p[áÁ]gina\sno\sencontrada\s?:",
]
#: How words of filler Latin end, and words that true text of the corpus' languages can hardly do without.
LATIN_ENDS = "a ae am at ct em et ia is it nt o or ora um ur us re".split()
FUNCTION_WORDS = """the a an and or of to in on for is are be by as at it if you your we our that this with from not no was were will can may
when where how what which who le la les des du un une et pour dans sur est sont que qui au aux par en der die das und für ist sind mit von
den dem ein eine auf bis el los las del una para por con es son y de sold through menu""".split()


def _by_first_letter(patterns: list[str], letters: int = 2) -> str:
    """The alternatives of patterns, grouped by their first letters, so that a word is tried against few of them. Those of
    a group of plain wordings that begins a pattern are set apart first."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        for q in _set_apart(p):
            groups.setdefault(q[0] if q[:1].isalpha() else "", []).append(q)
    alone = groups.pop("", [])
    inner = lambda own: _by_first_letter(own, letters - 1) if letters > 1 else "|".join(own)
    return "|".join([*(f"{c}(?:" + inner([q[1:] for q in own]) + ")" for c, own in sorted(groups.items())), *alone])


def _set_apart(pattern: str) -> list[str]:
    led = re.match(r"\(\?:([^()\[\]]*)\)(\?)?(?![?*+{])", pattern)
    if led is None:
        return [pattern]
    rest = pattern[led.end() :]
    return [w + rest for w in [*led[1].split("|"), *([""] if led[2] else [])]]


_PLACEHOLDER = "(?:(?=[\\[{<%@#_$«])(?:" + "|".join(DELIMITED) + ")|(?=[UuNnTtXx])\\b(?:" + "|".join(UNSET) + "))"
#: An exception's name ends where its message begins, so this one may start inside a word.
_EXCEPTION = r"[Ee](?i:xception\sat\s\w+\()"
#: For texts with a blank before them (``_led``): the character before a word comes first, so that places inside a word
#: are passed over by one comparison.
_PHRASE = r"(?:[^A-Za-z](?i:\b(?:" + _by_first_letter([*FILLER, *SCRIPTS, *ERRORS]) + "))|" + _EXCEPTION + ")"
_LATIN_WORD = r"(?i)\b[a-z]{2,}(?<=" + "|".join(LATIN_ENDS) + r")\b"
#: Three words in a row that end like Latin, the first two in a way in which few English words do; for texts with a
#: blank before them, as above.
_LATIN_RUN = (
    r"(?i)[^a-z](?:\b(?!(?:for|your|our|this|his|that|into|also|per)\b)[a-z]{3,}+(?<=[ao]|am|em|et|is|it|or|um|ur|us),?\s){2}"
    r"\b[a-z]{3,}+(?<=[ao]|am|em|et|is|it|or|um|ur|us|nt|ct|re|at)\b"
)
#: What true text holds: a function word, a figure or a mark between cells.
_TRUE_TEXT = r"(?iu)\b(?:" + "|".join(FUNCTION_WORDS) + r")\b|[|\d$>:/]"
_CODE = r"(?s)```.*?```|~~~.*?~~~|`[^`\n]{1,120}`|<(code|pre)\b[^>]*>.*?</\1>"
_QUOTED = r"(?<=[\s(])['‘\"“][^'’\"”\n]{1,80}['’\"”](?=[\s.,;:)!?]|$)"
_SENTENCES = r"(?<=[.!?])\s+(?=\p{Lu}|[\[{<«#$%@_])|\n(?=\s*\n)|\n(?=\s*[-–•*»«0-9])"
_TUTORIAL = (
    r"(?iu)\b(?:in\sthe\sformula|use\sthe\slabel|the\slabel|fields?\smarked|the\smessage|syntax|tutorial|markup|merge\sfields?"
    r"|placeholders\s(?:are|such|like)|template\s(?:language|engine|syntax|tags?)|type\sthe|shown\sas|stands\sfor|was\srepealed"
    r"|for\sexample,?\s(?:type|write)|e\.g\.\s(?:type|write))\b"
)

#: Titles that are themselves an error message, a notice or filler, after the site's name is taken off.
TITLES = [
    r"(?:error\s*)?[45]\d\d",
    r"(?:error\s+)?[45]\d\d[\s:–-]+(?:bad request|unauthori[sz]ed|forbidden|not found|gone|too many requests|request timeout"
    r"|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out)",
    r"(?:error|forbidden|unauthori[sz]ed|bad gateway|internal server error|gateway time-?out)",
    r"(?:access denied|request (?:blocked|rejected)|permission denied)",
    r"(?:page|file|document) not found|not found",
    r"service (?:temporarily )?unavailable",
    r"attention required|just a moment|one moment,? please|please wait.*|checking your browser.*",
    r"session (?:expired|timed out)|your session has expired",
    r"(?:the )?page you requested has .*",
    r"(?:site )?(?:is )?(?:under|down for) maintenance",
    r"oops\W.*|(?:sorry,? )?something went wrong.*",
    r"we can.?t find (?:that|the|this) page|(?:sorry,? )?this page isn.?t available",
    r"(?:please )?(?:enable|turn on) javascript.*|javascript is (?:required|disabled|not available|off)",
    r"are you a robot",
    r"page introuvable|seite nicht gefunden|página no encontrada|accès refusé|zugriff verweigert|acceso denegado",
    r"undefined|null|none|nan|n/a|tbc|tbd|title tbc|x{3,}|(?:test\s*){1,5}",
    r"untitled(?: (?:document|page|\d+))?|new page(?: \d+)?|sample page|(?:page )?title (?:goes )?here|page title goes here",
    r"lorem ipsum\b.*",
    r"%[a-z_.]+%|<[a-z_.]+>|\[(?:page |insert )?[a-z_.]+(?: here)?\]|\[insert [^\]]+\]",
]
_TITLE = r"(?iu)^\s*(?:guide:\s*)?(?:" + "|".join(TITLES) + r")[\s.!?…]*$"


def _spaced(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def _led(text: Column) -> Column:
    return F.concat(F.lit(" "), text)


def title_is_residue(title: Column) -> Column:
    """Whether a title is itself residue, filler, an error message or a notice; false if null or empty.

    A site name after the last " | " or " - " and a mark like "(archived)" are taken off first.
    """
    folded = F.trim(_spaced(fold_text(title)))
    bare = F.regexp_replace(folded, r"\s*\((?:archived|old|draft)\)", "")
    core = F.regexp_replace(bare, r"\s+\|[^|]*$", "")
    short = F.regexp_replace(core, r"\s+[-–]\s+[^-–]*$", "")
    hit = lambda c: F.rlike(c, F.lit(_TITLE)) | F.rlike(c, F.lit(r"^\s*" + _PLACEHOLDER + r"\s*$"))
    return F.coalesce((bare != "") & (hit(core) | hit(short)), F.lit(False))


def text_is_residue(text: Column) -> Column:
    """Whether a text is, or holds, residue, filler, an error message or a scripts notice.

    Null, empty and blank texts are not. A text of any length is looked at as a whole.
    """
    folded = fold_text(text)
    # spaced as the sentences are below, with fewer replacements
    spaced = F.regexp_replace(folded, r"\s(?:\s+|(?<! ))", " ")
    # bound by a lambda, so that a text is spaced once and not once a test
    suspect = F.exists(F.array(_led(spaced)), lambda t: F.rlike(t, F.lit(_PLACEHOLDER)) | F.rlike(t, F.lit(_PHRASE)) | F.rlike(t, F.lit(_LATIN_RUN)))
    plain = F.regexp_replace(F.regexp_replace(folded, _CODE, " "), _QUOTED, " ")
    lines = F.transform(F.split(plain, "\n"), _spaced)
    sentences = F.transform(F.split(plain, _SENTENCES), _spaced)
    filled = F.filter(sentences, lambda s: F.rlike(s, F.lit(_PLACEHOLDER)))
    explains = lambda s: F.rlike(F.regexp_replace(s, _PLACEHOLDER, " "), F.lit(_TUTORIAL))
    open_ones = F.size(F.filter(filled, lambda s: ~explains(s)))
    placeholder = (open_ones > 0) & (open_ones * 2 >= F.size(filled))
    words = lambda s: F.size(F.split(F.trim(s), " "))
    # filler Latin: at least five words, no true text among them, and most of them end like Latin
    latin = F.exists(
        F.flatten(F.transform(lines, lambda s: F.split(s, r"(?<=[.!?])\s"))),
        lambda s: F.rlike(_led(s), F.lit(_LATIN_RUN)) & ~F.rlike(s, F.lit(_TRUE_TEXT)) & (words(s) >= 5) & (F.regexp_count(s, F.lit(_LATIN_WORD)) * 5 >= words(s) * 3),
    )
    phrase = F.rlike(_led(_spaced(plain)), F.lit(_PHRASE))
    return F.coalesce(F.when(suspect, phrase | placeholder | latin).otherwise(F.lit(False)), F.lit(False))


def residue_found(inventory: DataFrame, chunks: DataFrame) -> DataFrame:
    """(src_table, rec_key): inventory rows with an error status or a residue title, chunks with residue.

    A row without its key gives nothing; a chunk delivered twice gives one row; a null status or title
    counts as no sign. Empty tables give an empty result.
    """
    pages = (
        inventory.where(F.coalesce(F.col("status") >= 400, F.lit(False)) | title_is_residue(F.col("title")))
        .where(F.col("inv_id").isNotNull())
        .select(F.lit("inventory").alias("src_table"), F.col("inv_id").cast("string").alias("rec_key"))
    )
    texts = (
        chunks.select("id", "text")
        .where(F.col("id").isNotNull() & text_is_residue(F.col("text")))
        .select(F.lit("chunks").alias("src_table"), F.col("id").alias("rec_key"))
    )
    return pages.unionByName(texts).distinct()


def without_residue(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``chunks`` whose text is no residue; all columns stay."""
    return chunks.where(~text_is_residue(F.col(text_col)))
