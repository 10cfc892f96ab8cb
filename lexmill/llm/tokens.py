"""Token counts with a public tokenizer, whose vocabulary file is named by its path."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level BPE vocabulary used unless another is named.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How that vocabulary's words are told apart before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SEAM = re.compile(r"\S(?= \S)")


@cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def stretches(text: str, length: int = 1 << 20) -> Iterator[str]:
    """A text in stretches of about ``length`` characters, each but the first beginning with a space between two marks.
    A word's pattern takes such a space as its first character, so that no token spans two stretches."""
    start = 0
    while (cut := _SEAM.search(text, start + length)) is not None:
        yield text[start : cut.end()]
        start = cut.end()
    yield text[start:]


def token_counts(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, *keep, tokens) for each document with an id and a text; an empty text has none, a null text no row.

    Whole texts are counted; a long one in stretches, which changes no count.
    """

    def size(text: str) -> int:
        return sum(len(encoding(vocabulary).encode_ordinary(p)) for p in stretches(text))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(tokens=pd.Series([size(t) for t in batch["__text"]], index=batch.index, dtype="int64")).drop(columns="__text")

    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), *keep, F.col(text_col).alias("__text"))
    kept = rows.drop("__text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return rows.mapInPandas(scan, f"{schema}, tokens long")
