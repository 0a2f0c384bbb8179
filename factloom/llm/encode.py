"""Problem 7: the corpus as token ids of a public tokenizer.

The rank file is read by each worker from a local path (a parameter); nothing
is trained or downloaded. Long texts are split before encoding at places that
no pre-token can span, which changes no id: every alternative of the pattern
either starts with at most one blank or is white space throughout, so a step
from a non-blank to a blank always ends a pre-token; and no alternative but the
contractions holds characters of two of the kinds letter, number and other, so
a step between a letter and a number does too. The memory of one call is
bounded by ``PIECE`` and the longest run without such a step, which is one
pre-token and cannot be split.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; texts are encoded whole, at any length;
repeated rows give repeated rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import ship

#: Where the rank file of byte_bpe_50k lies on every node.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-token pattern of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts longer than this are encoded piece by piece.
PIECE = 16_384
_SAFE = re.compile(r"(?<=\S)(?=\s)|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")
_ENCODERS: dict = {}


def encoder(ranks: str = RANKS, pattern: str = PATTERN):
    """The tokenizer of a rank file, read once per worker process."""
    if (ranks, pattern) not in _ENCODERS:
        import base64

        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[ranks, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _ENCODERS[ranks, pattern]


def pieces(text: str, size: int = PIECE):
    """The text in pieces of about ``size``, cut only where no pre-token goes on."""
    at = 0
    while len(text) - at > size:
        m = _SAFE.search(text, at + size)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def encode_text(text: str | None, enc) -> list[int]:
    """The ids of one text, without special tokens."""
    if not text:
        return []
    if len(text) <= PIECE:
        return enc.encode_ordinary(text)
    out: list[int] = []
    for p in pieces(text):
        out += enc.encode_ordinary(p)
    return out


def decode_ids(ids: list[int], enc) -> str:
    """The text of ids, by way of raw bytes, so that characters split between tokens come back whole."""
    return enc.decode_bytes(ids).decode("utf-8")


def _encode(ranks: str, pattern: str, only_count: bool):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        enc = encoder(ranks, pattern)
        for b in batches:
            lists = [encode_text(t, enc) for t in b.column(1).to_pylist()]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            if only_count:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes.astype(np.int32))], ["id", "n"])
                continue
            flat = np.fromiter((i for x in lists for i in x), np.int32, int(sizes.sum()))
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], ["id", "ids"])

    return run


def token_ids(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(ident, ids array<int>) of every row."""
    ship(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(_encode(ranks, pattern, False), f"id {kind}, ids array<int>").withColumnRenamed("id", ident)


def token_counts(docs: DataFrame, ident: str = "doc_id", text: str = "text", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(ident, n_tokens int) of every row, without shipping the ids."""
    ship(docs.sparkSession)
    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, text).mapInArrow(_encode(ranks, pattern, True), f"id {kind}, n int").withColumnsRenamed({"id": ident, "n": "n_tokens"})


def decoded(ids: DataFrame, ident: str = "doc_id", ranks: str = RANKS, pattern: str = PATTERN) -> DataFrame:
    """(ident, text) back from (ident, ids)."""
    ship(ids.sparkSession)
    kind = ids.schema[ident].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        enc = encoder(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([decode_ids(x, enc) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return ids.select(ident, "ids").mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", ident)
