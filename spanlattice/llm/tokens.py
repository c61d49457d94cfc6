"""Encoding with a public tokenizer of byte-level BPE over Arrow batches, and decoding.

A byte-level tokenizer writes each byte as one printable character; a token's bytes come back by reversing that table, so the tokens of
a text together are its UTF-8 bytes, even where a character is split between tokens. Character offsets come from the
tokenizer; byte offsets are sums of the tokens' byte lengths.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters encoded at once, so that long texts do not pile up in memory.
CHARS_AT_ONCE = 2_000_000


def vocabulary(name: str = "byte_bpe_50k.json", folder: str = "/opt/tokenizers") -> str:
    return f"{folder}/{name}"


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte: printable ones for themselves, the others from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


def _in_parts(texts: list[str | None]) -> Iterator[list[str]]:
    part, size = [], 0
    for x in texts:
        part.append(x or "")
        size += len(part[-1])
        if size > CHARS_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _lists(values: list[list[int]]) -> pa.Array:
    return pa.array(values, pa.list_(pa.int32()))


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """Rows (key, ids array<int>), one for each row. Null and empty texts have no tokens: an empty list, never null.

    The whole text is encoded, without special tokens. Repeated rows come out repeatedly; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            ids = [e.ids for part in _in_parts(b.column(1).to_pylist()) for e in t.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(ids)], [key, "ids"])

    return df.select(key, text).mapInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, ids array<int>")


def count_tokens(df: DataFrame, keys: list[str], text: str, path: str) -> DataFrame:
    """Rows (keys..., n_tokens int): the number of tokens of each row's text, 0 if it is null or empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            n = [len(e.ids) for part in _in_parts(b.column(len(keys)).to_pylist()) for e in t.encode_batch_fast(part, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keys)], pa.array(n, pa.int32())], [*keys, "n_tokens"])

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*keys, text).mapInArrow(run, f"{schema}, n_tokens int")


def encode_with_offsets(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """encode() with the places of each token: char_from, char_to (code points), byte_from, byte_to (UTF-8), half-open.

    Tokens that share a split character have the same character range; the byte ranges follow each other without gap.
    """
    names = [key, "ids", "char_from", "char_to", "byte_from", "byte_to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = load(path)
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for part in _in_parts(b.column(1).to_pylist()):
                for e in t.encode_batch(part, add_special_tokens=False):
                    ends, n = [], 0
                    for token in e.tokens:  # one character of a token stands for one byte
                        n += len(token)
                        ends.append(n)
                    for c, v in zip(cols, (e.ids, [a for a, _ in e.offsets], [z for _, z in e.offsets], [0, *ends[:-1]] if ends else [], ends)):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(_lists, cols)], names)

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}" + "".join(f", {n} array<int>" for n in names[1:])
    return df.select(key, text).mapInArrow(run, schema)


def decode(df: DataFrame, key: str, ids: str, path: str, also: list[str] | None = None) -> DataFrame:
    """Rows (key, bytes binary, text string): the tokens' bytes, and their text with U+FFFD for characters cut off. ``also`` are columns to keep.

    Null ids give nulls, an empty list the empty text. An id that is not in the vocabulary is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        byte_of = {c: b for b, c in byte_characters().items()}
        token = {i: bytes(byte_of[c] for c in w) if all(c in byte_of for c in w) else w.encode() for w, i in load(path).get_vocab().items()}
        for b in batches:
            raw = [None if x is None else b"".join(token[i] for i in x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary()), pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string()), *b.columns[2:]], [key, "bytes", "text", *(also or [])])

    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, bytes binary, text string" + "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in also or [])
    return df.select(key, ids, *(also or [])).mapInArrow(run, schema)
