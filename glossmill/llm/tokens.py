"""Encoding with a public tokenizer by monoid tree reduction.

A text is halved until the parts are small, the parts are encoded, and neighbours are joined: around the seam a window
grows on both sides until it ends at a place where the tokenizer's pre-splitting pattern must cut whatever stands
beyond. Tokens outside the window are final, those inside are encoded again. Joining is associative and an empty text
is its unit, so any bracketing gives the ids of the whole text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FOLDER, NAME = "/opt/tokenizers", "byte_bpe_50k"
# Fixed value: the pre-splitting pattern of the tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF, WINDOW = 1 << 11, 64

#: The pattern must cut before white space that follows a character that is none, and between an ASCII letter and
#: digit. No match holds such a pair, and no lookahead reaches across it.
_CUT = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n\t])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


@lru_cache(4)
def encoding(folder: str = FOLDER, name: str = NAME) -> tiktoken.Encoding:
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _last_cut(text: str, low: int, high: int) -> int | None:
    at = None
    for m in _CUT.finditer(text, low + 1, high):
        at = m.start()
    return at


def _left(text: str, low: int, mid: int) -> int:
    """Start of the window: the nearest sure cut before the seam, looked for in growing stretches."""
    size = WINDOW
    while mid - size > low:
        if (at := _last_cut(text, mid - size, mid + 1)) is not None:
            return at
        size *= 2
    at = _last_cut(text, low, mid + 1)
    return low if at is None else at


def _right(text: str, mid: int, high: int) -> int:
    m = _CUT.search(text, mid, high)
    return m.start() if m else high


def join(enc, text: str, low: int, mid: int, high: int, a: list[int], b: list[int]) -> list[int]:
    """Ids of text[low:high] from those of its two parts."""
    l, r = _left(text, low, mid), _right(text, mid, high)
    if l == mid or r == mid:
        return a + b
    drop, skip = len(enc(text[l:mid])), len(enc(text[mid:r]))
    return a[: len(a) - drop] + enc(text[l:r]) + b[skip:]


def encode(text: str | None, enc=None, leaf: int = LEAF) -> list[int]:
    """Token ids of a text without special tokens; of a null or empty text the empty list."""
    enc = enc or encoding().encode_ordinary
    if not text:
        return []

    def tree(low: int, high: int) -> list[int]:
        if high - low <= leaf:
            return enc(text[low:high])
        mid = (low + high) // 2
        return join(enc, text, low, mid, high, tree(low, mid), tree(mid, high))

    return tree(0, len(text))


def decode(ids: list[int], enc: tiktoken.Encoding | None = None) -> str:
    """The text of ids: halves decode to bytes, bytes are joined up the tree, and read as UTF-8 once at the top."""
    enc = enc or encoding()

    def tree(low: int, high: int) -> bytes:
        if high - low <= LEAF:
            return enc.decode_bytes(ids[low:high])
        mid = (low + high) // 2
        return tree(low, mid) + tree(mid, high)

    return tree(0, len(ids)).decode("utf-8", "replace")


def encode_corpus(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key`` and ``ids`` (array of int) of each row; null and empty texts give the empty array.

    Strings that look like special tokens are ordinary text. Whole texts of any length; repeated keys and rows give
    rows of their own. Other columns do not reach the result. No shuffle: Arrow batches in the scan's tasks. The
    tokenizer's files are read on each worker from ``folder``.
    """
    rows = df.select(F.col(key), F.col(text).alias("__text"))
    schema = df.select(key).schema.add("ids", T.ArrayType(T.IntegerType()))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name).encode_ordinary
        for whole in batches:
            for batch in _portions(whole):
                each = [encode(t, enc) for t in batch.column(1).to_pylist()]
                ends = np.zeros(len(each) + 1, np.int32)
                np.cumsum([len(x) for x in each], out=ends[1:])
                flat = np.fromiter((i for x in each for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[batch.schema.names[0], "ids"])

    return rows.mapInArrow(ids, schema)


def token_counts(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key`` and ``n_tokens`` (bigint) of each row; 0 for null and empty texts."""
    rows = df.select(F.col(key), F.col(text).alias("__text"))
    schema = df.select(key).schema.add("n_tokens", T.LongType())

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name).encode_ordinary
        for batch in batches:
            n = [len(encode(t, enc)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=[batch.schema.names[0], "n_tokens"])

    return rows.mapInArrow(counts, schema)


def roundtrip(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = NAME) -> DataFrame:
    """``key`` and ``same``: whether decoding the encoded text gives the text; true for null and empty texts."""
    rows = df.select(F.col(key), F.col(text).alias("__text"))
    schema = df.select(key).schema.add("same", T.BooleanType())

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(folder, name)
        for batch in batches:
            ok = [decode(encode(t, enc.encode_ordinary), enc) == (t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_())], names=[batch.schema.names[0], "same"])

    return rows.mapInArrow(same, schema)


def _portions(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of text, so that what is sent back stays small."""
    total = pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
    step = max(1, batch.num_rows * most // max(most, total))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)
