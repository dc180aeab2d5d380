"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from nebulith.runtime import ship

TOKENIZER = os.environ.get("NEBULITH_TOKENIZER", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: How the byte-level vocabularies split a text before their merges (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(maxsize=2)
def load(path: str):
    """The tokenizer of a rank file, once for each worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}
    return tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def prompt_end(text: str) -> int:
    """Length of the prompt part: the first paragraph where others follow, else nothing."""
    at = text.find("\n\n")
    return at + 2 if 0 <= at and text[at + 2:].strip() else 0


def token_counts(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, n_loss): tokens of the whole text, and those after its prompt part (loss-bearing).

    Null and empty texts have 0; a row without a doc_id names no text and is left out. Texts of special-token strings count as ordinary text. Whole texts are encoded.
    """

    ship(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = load(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch["doc_id"], batch["text"]):
                if not isinstance(text, str) or not text:
                    out.append((doc, 0, 0))
                    continue
                cut = prompt_end(text)
                head = len(enc.encode_ordinary(text[:cut])) if cut else 0
                tail = len(enc.encode_ordinary(text[cut:]))
                out.append((doc, head + tail, tail))
            yield pd.DataFrame(out, columns=["doc_id", "n_tokens", "n_loss"])

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text").mapInPandas(count, "doc_id long, n_tokens long, n_loss long")
