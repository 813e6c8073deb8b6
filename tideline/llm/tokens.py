"""Token counts by a public tokenizer. The vocabulary's path is a parameter; the file must be there on every worker."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.common import once_per_key

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the byte-level vocabulary's texts are cut into words.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(4)
def encoding(path: str = VOCABULARY):
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, key: str = "doc_id", keep: tuple[str, ...] = (), vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, *keep, tokens): tokens of every non-null text, once per key."""
    docs = once_per_key(documents.where(F.col("text").isNotNull()).select(key, *keep, "text"), key)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            n = pa.array([len(enc.encode_ordinary(t)) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(c) for c in (key, *keep)] + [n], names=[key, *keep, "tokens"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(count, kinds + ", tokens long")
