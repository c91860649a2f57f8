"""Byte-level BPE encoding and decoding with a local rank file.

Short texts go to the library as they are. Long texts are cut first, at places where the splitting pattern
ends a match whatever follows: after a letter or digit and before a blank. A stretch without such a place is
split by the pattern here and encoded piece by piece, so that no text is too long for the library's regular
expression engine. Ids decode to raw bytes, which need not be valid UTF-8 for a part of a text.

Defined results: a null or empty text has no tokens and decodes to no bytes; every input row gives one
result row, repeated rows too; an empty table gives an empty table; only the id and the text are read, so
other columns of the input never matter.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import public_tokenizers
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from plumbline.llm.common import narrow, per_batch, texts, type_of

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LONG_TEXT = 50_000  # code points that are handed to the library at once

_SAFE = re.compile(r"(?<=[A-Za-z0-9])(?=[ \n])")
# \s of the library is the White_Space property.
_PIECES = regex.compile(public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


class Codec:
    """The tokenizer of one rank file, loaded once in each Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.library = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.decimal = [str(i) for i in range(max(ranks.values()) + 1)]

    def encode(self, text: str) -> list[int]:
        if len(text) <= LONG_TEXT:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text, LONG_TEXT):
            if len(part) <= 2 * LONG_TEXT:
                ids += self.library.encode_ordinary(part)
            else:
                for match in _PIECES.finditer(part):
                    ids += self.library._encode_single_piece(match[0].encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library._core_bpe.decode_bytes(ids)

    def joined(self, ids: list[int]) -> str:
        decimal = self.decimal
        return " ".join([decimal[i] for i in ids])


def safe_parts(text: str, size: int) -> Iterator[str]:
    """Parts of about ``size`` code points, cut only where no match of the pattern can span the cut."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@functools.lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, ranks: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``token_ids`` of every text."""

    def work(batch: pa.RecordBatch) -> dict:
        tokenizer = codec(ranks)
        return {key: batch.column(0), "token_ids": [tokenizer.encode(t) for t in texts(batch, 1)]}

    return per_batch(narrow(docs, key, text), f"`{key}` {type_of(docs, key)}, token_ids array<int>", work)


def decode(tokens: DataFrame, ranks: str = RANKS, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """``key`` and the bytes that the ids stand for; null ids give no bytes."""

    def work(batch: pa.RecordBatch) -> dict:
        tokenizer = codec(ranks)
        return {key: batch.column(0), "decoded": [tokenizer.decode(row.as_py() or []) for row in batch.column(1)]}

    return per_batch(narrow(tokens, key, ids), f"`{key}` {type_of(tokens, key)}, decoded binary", work)


def round_trip(docs: DataFrame, ranks: str = RANKS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text, decode its ids, and digest both in the same batch.

    ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space), ``decoded_sha256`` (of the decoded
    bytes) and ``restored`` (the bytes are those of the text). The ids never leave the task.
    """

    def work(batch: pa.RecordBatch) -> dict:
        tokenizer = codec(ranks)
        counts, of_ids, of_bytes, restored = [], [], [], []
        for value in texts(batch, 1):
            ids = tokenizer.encode(value)
            raw = tokenizer.decode(ids)
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(tokenizer.joined(ids).encode()).hexdigest())
            of_bytes.append(hashlib.sha256(raw).hexdigest())
            restored.append(raw == value.encode())
        return {key: batch.column(0), "n_tokens": counts, "ids_sha256": of_ids, "decoded_sha256": of_bytes, "restored": restored}

    schema = f"`{key}` {type_of(docs, key)}, n_tokens long, ids_sha256 string, decoded_sha256 string, restored boolean"
    return per_batch(narrow(docs, key, text), schema, work)


def with_token_ids(docs: DataFrame, ranks: str = RANKS, text: str = "text") -> DataFrame:
    """The documents' columns with ``token_ids`` at the end, which replaces a column of that name."""
    own = docs.select([c for c in docs.columns if c != "token_ids"])
    schema = StructType([*own.schema.fields, StructField("token_ids", ArrayType(IntegerType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = codec(ranks)
        for batch in batches:
            ids = pa.array([tokenizer.encode(t) for t in texts(batch, text)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], schema=arrow)

    return own.mapInArrow(run, schema)
