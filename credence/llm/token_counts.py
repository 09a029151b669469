"""Token counts: batches balanced by bytes are encoded in Arrow functions, and only lengths come back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from credence.llm.common import batches_by_bytes, map_texts
from credence.llm.encoding import encoder, tokenizer_path

BATCH_CHARS = 500_000
LIMIT = 512


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = LIMIT,
                 tokenizer: str | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit.

    ``tokenizer`` is the path of a byte-level tokenizer file. Encoding is without added special tokens;
    special strings inside a text count as the library counts them. A null text counts as an empty one
    (0 bytes, 0 tokens); keys may be null or repeat, each row is counted by itself; other columns are
    not read. Long texts are encoded in segments between safe boundaries, so a task holds one segment's
    pieces and not a whole text's.
    """
    path = tokenizer or tokenizer_path()

    def work(pairs: Iterator[tuple[Any, str | None]]) -> Iterable[tuple]:
        for run in batches_by_bytes(pairs, batch_chars):
            ids = encoder(path).encode([t for _, t in run])
            for (k, t), e in zip(run, ids):
                n = len(e) // 4
                yield k, len(t.encode("utf-8")), n, n > limit

    kind = docs.schema[key].dataType.simpleString()
    counted = map_texts(docs, F.col(key), F.col(text), work, f"k {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
    return counted.withColumnRenamed("k", key)
