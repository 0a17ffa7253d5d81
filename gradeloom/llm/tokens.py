"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.arrow import map_rows

#: Where the vocabulary files lie on every machine; never copied into the package.
FOLDER = "/opt/tokenizers"
# Fixed value: the pattern that cuts a text into the pieces that the byte-level vocabulary was made on.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def token_counter(folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> Callable[[str], int]:
    """A function that gives the number of tokens of a text."""
    import tiktoken

    with open(f"{folder}/{name}", "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    encode = tiktoken.Encoding(name, pat_str=PIECES, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda text: len(encode(text))


def document_sizes(documents: DataFrame, folder: str = FOLDER, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, source, n_tokens of each document; null and empty texts have no tokens. Repeated rows stay repeated."""

    def sizes(rows: Iterable[tuple]) -> Iterator[tuple]:
        count = None
        for doc, source, text in rows:
            count = count or token_counter(folder, name)
            yield doc, source, count(text) if text else 0

    narrow = documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string"))
    return map_rows(narrow, "doc_id bigint, source string, n_tokens bigint", sizes)
