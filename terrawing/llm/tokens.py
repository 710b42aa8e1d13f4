"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; never part of this repository.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
#: Byte-level BPE with 50,256 ranks, in tiktoken's format.
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published splitting pattern that belongs to this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""

_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a rank file, once per worker."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _encoders[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def count(text: str | None, enc) -> int:
    """Tokens of the whole text; 0 for null. Lone surrogates count as the replacement character."""
    if not text:
        return 0
    try:
        return len(enc.encode_ordinary(text))
    except UnicodeEncodeError:
        return len(enc.encode_ordinary(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")))


def with_tokens(df: DataFrame, text: str, keep: list[str], folder: str = VOCABULARIES, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` of df and ``n_tokens`` (long), one row per row of df. Whole texts are counted; they don't leave the scan."""
    path = os.path.join(folder, vocabulary)
    slim = df.select(*keep, F.col(text).alias("_text"))
    schema = slim.drop("_text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            sizes = [count(x.as_py(), enc) for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], [*batch.schema.names[:-1], "n_tokens"])

    return slim.mapInArrow(run, schema.add("n_tokens", "long"))
