"""Evidence, references, prompts and the parsing of model replies, for batches of requests.

Calls to a language model are the caller's; they belong between ``prompts`` and ``functions.text.clean_answer``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions import text as X

_UNDERSTOOD = "intent string, understood_need string, search_queries array<string>, response string"


def evidence(results: DataFrame, order: str = "pick") -> DataFrame:
    """(qid, evidence): the results of each request as numbered blocks."""
    header = X.heading_prefix(F.coalesce("title", F.lit("")), F.coalesce("section_heading", F.lit("")))
    block = F.concat(F.lit("["), F.col(order).cast("string"), F.lit("] "), header, F.lit("\n    URL: "), F.coalesce("url", F.lit("")), F.lit("\n    "), F.coalesce("text", F.lit("")))
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), block.alias("b"))))
    return results.groupBy("qid").agg(F.array_join(F.transform(listed, lambda x: x["b"]), "\n\n").alias("evidence"))


def references(results: DataFrame, order: str = "pick") -> DataFrame:
    """(qid, ref_number, title, section, url, breadcrumb, snippet) of each result."""
    clean = lambda c: F.coalesce(c, F.lit(""))
    return results.select("qid", F.col(order).cast("long").alias("ref_number"), clean("title").alias("title"), clean("section_heading").alias("section"), clean("url").alias("url"), clean("breadcrumb").alias("breadcrumb"), F.substring(clean("text"), 1, 200).alias("snippet"))


def history(messages: DataFrame, last: int = 6, most_chars: int = 300) -> DataFrame:
    """(conv, history): each conversation's last messages as lines, if it has two or more.

    ``messages``: conv, turn, role, content. Any speaker but the user is the assistant.
    """
    by = Window.partitionBy("conv")
    recent = messages.withColumn("__n", F.row_number().over(by.orderBy(F.desc("turn")))).withColumn("__all", F.count(F.lit(1)).over(by)).where((F.col("__all") >= 2) & (F.col("__n") <= last))
    line = F.concat(F.when(F.col("role") == "user", "User").otherwise("Assistant"), F.lit(": "), F.substring(F.coalesce("content", F.lit("")), 1, most_chars))
    listed = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return recent.groupBy("conv").agg(F.concat(F.lit("Recent conversation:\n"), F.array_join(F.transform(listed, lambda x: x["line"]), "\n"), F.lit("\n\n")).alias("history"))


def prompts(requests: DataFrame) -> DataFrame:
    """(qid, prompt) from qid, question, need, history and evidence; the need is told only where it differs."""
    hint = F.when(F.coalesce("need", "question") != F.col("question"), F.concat(F.lit("(Underlying need: "), F.col("need"), F.lit(")\n\n"))).otherwise("")
    return requests.select("qid", F.concat(F.coalesce("history", F.lit("")), hint, F.lit("Question: "), "question", F.lit("\n\nEvidence:\n"), F.coalesce("evidence", F.lit("")), F.lit("\n\nAnswer from the evidence and cite sources as [1], [2].")).alias("prompt"))


def understood(raw: Column, query: Column, most: int = 3) -> Column:
    """A model's JSON reply as (intent, understood_need, search_queries, response); what is missing or unreadable is
    taken from the query itself."""
    reply = F.from_json(X.without_fence(raw), _UNDERSTOOD)
    queries = F.slice(F.coalesce(reply["search_queries"], F.array(query)), 1, most)
    return F.struct(
        F.coalesce(reply["intent"], F.lit("question")).alias("intent"),
        F.coalesce(reply["understood_need"], query).alias("understood_need"),
        F.when(F.size(queries) > 0, queries).otherwise(F.array(query)).alias("search_queries"),
        F.coalesce(reply["response"], F.lit("")).alias("response"),
    )


def cited(answers: DataFrame, refs: DataFrame) -> DataFrame:
    """(qid, ref_number, url): the references that each answer cites, once each; other numbers cite nothing."""
    numbers = answers.select("qid", F.explode(F.transform(F.array_distinct(X.citations(F.col("answer"))), lambda n: n.cast("long"))).alias("ref_number"))
    return numbers.join(refs.select("qid", "ref_number", "url"), ["qid", "ref_number"])


def valid_query(query: Column, longest: int = 500) -> Column:
    """1 to ``longest`` characters; blanks alone are let through."""
    return F.coalesce(F.length(query).between(1, longest), F.lit(False))
