"""Cutting oversized texts at natural boundaries, with overlap.

Three expression steps per row, no shuffle and no Python:

1. Line breaks that a hard wrap put inside a sentence are told from line ends, and become spaces.
2. Bounded-quantifier extraction reads the text as units, with alternatives ordered by boundary strength:
   up to a line end, else up to a sentence end, else up to the word limit, else up to a number of characters
   where one word is longer than that.
3. An ordered fold over the units' word counts packs them into pieces under the limit; a piece starts
   ``overlap`` words before the end of the one before it, by an offset into the array of words. A word of more than
   ``word_chars`` characters counts as several words there and may be cut between them; for places it is one word.

Words are separated by spaces and line breaks only; a text of n words has int(1.3 n) tokens. A semicolon ends no
sentence, whatever follows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKENS_PER_WORD = 1.3

#: Shortened words whose full stop ends no sentence.
SHORT_WORDS = """e.g i.e etc approx s ss sec no nos inc co corp ltd dr mr mrs ms prof st vs fig art para p pp cf jr sr dept est
min max ref z.b ca bzw nr p.ex sra""".split()

_SHORT = "|".join(w.replace(".", r"\.") for w in SHORT_WORDS)
#: The point between two sentences of one line: end mark, closing quotes, then spaces; no shortened word before.
_END = rf"(?<=[.!?][)\]\"'”’]{{0,2}})(?<!(?i:\b(?:{_SHORT}))\.)"
_SENTENCE_END = rf"(?= ){_END}"
#: What shows that a line is running text: a sentence end, or a clause end before a capital or bullet, and more words.
_RUNNING = rf"(?= )(?:{_END}|(?<=;)(?= +(?:\p{{Lu}}|[-–—•*] ))) +[^ ]"
_CLOSED = r"[.!?…][)\]\"'”’]* *$"
_SHORTENED = rf"(?i)(?:^|[\s(>])(?:{_SHORT})\. *$"
#: From this length on, running text that breaks off is a wrapped line wherever it stands; a shorter line (most are
#: notices and list items) must fill the width of its text.
_SURELY_WRAPPED = 100
#: Columns beyond which no hard wrap is set, so that a row of a table that is as long has not been wrapped.
_WIDEST_WRAP = 400
#: A table row of several cells.
_ROW = r"^(?:[^|\n]*\|){3}"
_BULLET = r"^\s*(?:[-–—•*»«·]|\d+[.)])\s"


def words_in(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[^ \n]+"))


def max_words(limit_tokens: int) -> int:
    """The most words whose token count does not exceed the limit."""
    words = int((limit_tokens + 1) / TOKENS_PER_WORD) + 1
    while int(words * TOKENS_PER_WORD) > limit_tokens:
        words -= 1
    return words


def _unwrapped(text: Column) -> Column:
    """The text with the breaks of hard-wrapped lines turned into spaces.

    A line is full if the next line's first word would have made it longer than the text's longest line. A line breaks
    off inside a sentence if it has no end mark (a shortened word's is none, nor a semicolon before a small letter),
    goes on in the next line, and one of these holds: it is running text, and long or full; it is as long as the lines of
    this text for which that is so; it is full in a text most of whose lines are. A row of a table breaks off if the next
    line has cells too, and it is long (but no longer than any wrap), or full in a text most of whose lines are.
    """
    lines = F.split(text, "\n", -1)
    like = lambda x, pattern: F.rlike(x, F.lit(pattern))
    widest = F.array_max(F.transform(lines, lambda x: F.length(x)))

    def judged(x: Column, i: Column) -> Column:
        following = F.get(lines, i + 1)
        goes_on = following.isNotNull() & (F.trim(following) != "") & (F.trim(x) != "")
        full = F.length(x) + 1 + F.length(F.substring_index(F.ltrim(following), " ", 1)) > widest
        open_end = ~like(x, _CLOSED) | like(x, _SHORTENED)
        long = F.length(x) >= _SURELY_WRAPPED
        cells = like(x, _ROW)
        running = (long | full) & like(x, _RUNNING)
        return F.struct(
            x.alias("x"),
            F.coalesce(goes_on & full, F.lit(False)).alias("full"),
            F.coalesce(goes_on, F.lit(False)).alias("goes_on"),
            F.coalesce(goes_on & ~like(following, _BULLET) & open_end & (~like(x, "; *$") | like(following, r"^ *\p{Ll}")), F.lit(False)).alias("open"),
            F.coalesce(goes_on & ~like(following, _BULLET) & cells & F.contains(following, F.lit("|")), F.lit(False)).alias("row"),
            cells.alias("cells"),
            (long & (F.length(x) <= _WIDEST_WRAP)).alias("long"),
            (running & open_end & ~like(x, "; *$")).alias("wrapped"),
            (running & open_end).alias("running"),
        )

    def mended(all_lines: Column) -> Column:
        width = F.array_min(F.transform(F.filter(all_lines, lambda s: s["wrapped"]), lambda s: F.length(s["x"])))
        mostly = 2 * F.size(F.filter(all_lines, lambda s: s["full"])) >= F.size(F.filter(all_lines, lambda s: s["goes_on"]))
        # an array of one, so that the two figures are taken once for all lines
        figures = F.array(F.struct(all_lines.alias("lines"), width.alias("width"), mostly.alias("mostly")))

        def joined(f: Column) -> Column:
            def one(s: Column) -> Column:
                as_long = F.coalesce(F.length(s["x"]) >= f["width"], F.lit(False))
                fills = s["full"] & f["mostly"]
                filled = as_long | (fills & ~s["cells"])
                wraps = (s["row"] & (s["long"] | fills)) | (s["open"] & (s["running"] | (filled & ~like(s["x"], _BULLET))))
                return F.concat(s["x"], F.when(wraps, " ").otherwise("\n"))

            return F.array_join(F.transform(f["lines"], one), "")

        return F.get(F.transform(figures, joined), F.lit(0))

    whole = F.get(F.transform(F.array(F.transform(lines, judged)), mended), F.lit(0))
    return F.when(F.contains(text, F.lit("\n")), whole).otherwise(text)


def _word(word_chars: int | None) -> str:
    """A word, or a word's next ``word_chars`` characters where these are given."""
    return r"[^ \n]++" if word_chars is None else rf"[^ \n]{{1,{word_chars}}}+"


def _unit_pattern(word_limit: int, word_chars: int | None) -> str:
    """Alternatives by strength: to a line end, to a sentence end, to the word limit, to the character limit."""
    word = _word(word_chars)
    to_sentence = rf"(?:{word} +){{0,{word_limit - 1}}}?{word}(?: *\n[ \n]*|{_SENTENCE_END} +|\s*$)"
    to_limit = rf"(?:{word}[ \n]+){{1,{word_limit}}}"
    return rf"[ \n]*(?:{to_sentence}|{to_limit}|{word})"


def natural_units(text: Column, limit_tokens: int = 384, word_chars: int | None = None) -> Column:
    """The text as an array of units, each up to the next natural boundary, or the limit where none is near. A word
    stays whole, unless ``word_chars`` says from which length on it is cut."""
    return F.regexp_extract_all(_unwrapped(text), F.lit(_unit_pattern(max_words(limit_tokens), word_chars)), 0)


def oversized(text: Column, limit_tokens: int = 384) -> Column:
    """Whether the text has more tokens than the limit; false if null."""
    return F.coalesce((F.length(text) > 2 * max_words(limit_tokens)) & (words_in(text) > max_words(limit_tokens)), F.lit(False))


def cut_places(chunks: DataFrame, limit_tokens: int = 384, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, word_pos): every natural boundary inside the oversized texts, as the number of words before it.

    The end of the text is no place. Null texts and ids give nothing; repeated rows give each place once.
    """
    units = natural_units(F.col("text"), limit_tokens)
    closed = rf"(?:\n[ \n]*|{_END} +)$"
    places = F.aggregate(
        F.col("units"),
        F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at")),
        lambda acc, u: F.struct(
            (acc["n"] + words_in(u)).alias("n"),
            F.when(F.rlike(u, F.lit(closed)), F.array_append(acc["at"], acc["n"] + words_in(u))).otherwise(acc["at"]).alias("at"),
        ),
        lambda acc: acc["at"],
    )
    return (
        chunks.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        .where(F.col("id").isNotNull() & oversized(F.col("text"), limit_tokens))
        .select("id", words_in(F.col("text")).alias("words"), units.alias("units"))
        .select("id", "words", F.explode(places).alias("word_pos"))
        .where((F.col("word_pos") > 0) & (F.col("word_pos") < F.col("words")))
        .select("id", "word_pos")
        .distinct()
    )


def _spans(units: Column, room: int, word_chars: int) -> Column:
    """Ordered fold: spans (from, to) in words, packing units while they fit into ``room`` words."""
    pattern = F.lit(_word(word_chars))
    empty = F.array().cast("array<struct<start:int,stop:int>>")
    start = F.struct(F.lit(0).alias("start"), F.lit(0).alias("stop"), empty.alias("done"))

    def step(acc: Column, unit: Column) -> Column:
        size = F.regexp_count(unit, pattern)
        full = (acc["stop"] - acc["start"] + size > room) & (acc["stop"] > acc["start"])
        span = F.struct(acc["start"].alias("start"), acc["stop"].alias("stop"))
        return F.struct(
            F.when(full, acc["stop"]).otherwise(acc["start"]).alias("start"),
            (acc["stop"] + size).alias("stop"),
            F.when(full, F.array_append(acc["done"], span)).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(
        units,
        start,
        step,
        lambda acc: F.array_append(acc["done"], F.struct(acc["start"].alias("start"), acc["stop"].alias("stop"))),
    )


def split_oversized(
    chunks: DataFrame,
    limit_tokens: int = 384,
    overlap_words: int = 32,
    id_col: str = "id",
    text_col: str = "text",
    url_col: str = "url",
    index_col: str = "chunk_index",
    total_col: str = "chunk_total",
    word_chars: int = 2000,
) -> DataFrame:
    """``chunks`` with oversized texts as pieces, and index and total renumbered within the page.

    Added: ``piece`` (from 0), ``pieces`` and ``word_from`` (words before the piece, overlap included; a word of an
    oversized text that is longer than ``word_chars`` is as many words as it has parts, and may be cut between). Each
    id counts once, taking the first of its deliveries by content. Texts that are null, blank or small
    enough stay as they are, as one piece. A page without address is numbered for itself. Other columns stay.
    """
    most = max_words(limit_tokens)
    if not 0 <= overlap_words < most:
        raise ValueError("overlap_words must be less than the limit in words")
    base = chunks.drop("piece", "pieces", "word_from")
    text = F.col(text_col)
    words = F.regexp_extract_all(text, F.lit(_word(word_chars) + r"[ \n]*"), 0)
    units = natural_units(text, limit_tokens - int(overlap_words * TOKENS_PER_WORD) - 1, word_chars)
    spans = F.when(oversized(text, limit_tokens), _spans(units, most - overlap_words, word_chars))
    first = F.greatest(F.col("__span.start") - F.lit(overlap_words), F.lit(0))
    cut = F.rtrim(F.array_join(F.slice("__words", first + 1, F.col("__span.stop") - first), ""))
    pieces = (
        base.withColumn("__spans", spans)
        .withColumn("__words", F.when(F.col("__spans").isNotNull(), words))
        .withColumn("pieces", F.coalesce(F.size("__spans"), F.lit(1)).cast("long"))
        .select("*", F.posexplode_outer("__spans").alias("__piece", "__span"))
        .withColumn("piece", F.coalesce("__piece", F.lit(0)).cast("long"))
        .withColumn("word_from", F.when(F.col("__span").isNotNull(), first).otherwise(0).cast("long"))
        .withColumn(text_col, F.when(F.col("__span").isNotNull(), F.regexp_replace(cut, "[ \n]+$", "")).otherwise(text))
        .drop("__spans", "__words", "__piece", "__span")
    )
    # Numbers within a page: totals of pieces by (page, hundred of indexes) are summed first, so that the page
    # which holds a tenth of all rows is numbered by many tasks.
    page = F.coalesce(F.col(url_col), F.concat(F.lit("id:"), F.col(id_col)))
    keyed = pieces.withColumn("__page", page).withColumn("__slot", F.floor(F.coalesce(F.col(index_col), F.lit(0)) / 100))
    one = keyed.dropDuplicates(["__page", id_col, "piece"])
    by_slot = one.groupBy("__page", "__slot").agg(F.count(F.lit(1)).alias("__n"))
    starts = by_slot.withColumn(
        "__before",
        F.sum("__n").over(Window.partitionBy("__page").orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)),
    ).withColumn("__all", F.sum("__n").over(Window.partitionBy("__page")))
    within = F.row_number().over(Window.partitionBy("__page", "__slot").orderBy(F.col(index_col), F.col(id_col), F.col("piece")))
    numbered = one.withColumn("__within", within).join(starts.drop("__n"), ["__page", "__slot"])
    return numbered.withColumns(
        {
            index_col: (F.coalesce("__before", F.lit(0)) + F.col("__within") - 1).cast("int"),
            total_col: F.col("__all").cast("int"),
        }
    ).drop("__page", "__slot", "__within", "__before", "__all")
