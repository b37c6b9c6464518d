"""Encoding with a public tokenizer, with offsets, and decoding by its byte table."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
_loaded: dict = {}


def tokenizer(path: str):
    """The tokenizer of a vocabulary file, loaded once in a worker. Texts that spell a special token stay ordinary text."""
    if path not in _loaded:
        # tasks are spread over the cores already: no threads of the library's own
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        t.no_padding()
        t.no_truncation()
        _loaded[path] = t
    return _loaded[path]


def _texts(col: pa.Array, chars: int = 400_000) -> Iterator[tuple[int, int, list[str]]]:
    """Slices of about ``chars`` characters; null becomes empty."""
    texts = ["" if t is None else t for t in col.to_pylist()]
    a = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield a, i + 1, texts[a : i + 1]
            a, size = i + 1, 0
    if a < len(texts):
        yield a, len(texts), texts[a:]


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    for batch in batches:
        for a, b, texts in _texts(batch.column(1)):
            ids = [e.ids for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    for batch in batches:
        for a, b, texts in _texts(batch.column(1)):
            n = [len(e) for e in t.encode_batch_fast(texts, add_special_tokens=False)]
            yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for i, c in enumerate(batch.columns) if i != 1), pa.array(n, pa.int64())], [*(n for i, n in enumerate(batch.schema.names) if i != 1), "n_tokens"])


def _spans(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = tokenizer(path)
    for batch in batches:
        for a, b, texts in _texts(batch.column(1)):
            es = t.encode_batch(texts, add_special_tokens=False)
            s, e = [[x for x, _ in i.offsets] for i in es], [[y for _, y in i.offsets] for i in es]
            k = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([i.ids for i in es], k), pa.array(s, k), pa.array(e, k)], ["id", "ids", "starts", "ends"])


def _source(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string").alias("_text"), *[F.col(f"`{m}`") for m in more])


def encode(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): each row's text without special tokens; null and empty texts give an empty list.

    Rows map one to one: repeated keys and null keys stay. There is no shuffle; a long text is encoded whole.
    """
    kind = docs.schema[key].dataType.simpleString()
    return _source(docs, key, text).mapInArrow(partial(_encode, path=path), f"id {kind}, ids array<int>").withColumnRenamed("id", key)


def encode_spans(docs: DataFrame, key: str, text: str, path: str = VOCABULARY) -> DataFrame:
    """``encode`` with each token's character range (starts, ends). Tokens that split a character share its range."""
    kind = docs.schema[key].dataType.simpleString()
    out = _source(docs, key, text).mapInArrow(partial(_spans, path=path), f"id {kind}, ids array<int>, starts array<int>, ends array<int>")
    return out.withColumnRenamed("id", key)


def count(docs: DataFrame, key: str, text: str, more: tuple[str, ...] = (), path: str = VOCABULARY) -> DataFrame:
    """(key, *more, n_tokens): the lengths of ``encode``."""
    cols = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in (key, *more))
    return _source(docs, key, text, *more).mapInArrow(partial(_count, path=path), f"{cols}, n_tokens long")


def byte_table() -> dict[str, int]:
    """Character to byte of byte-level BPE: printable bytes stand for themselves, the rest for U+0100 onwards in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _decode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    table = byte_table()
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    piece = {i: bytes(table[c] for c in s) for s, i in model["model"]["vocab"].items() if all(c in table for c in s)}
    piece |= {a["id"]: a["content"].encode() for a in model.get("added_tokens", [])}
    for batch in batches:
        out = [None if ids is None else b"".join(piece[i] for i in ids).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["id", "text"])


def decode(encoded: DataFrame, key: str, ids: str, path: str = VOCABULARY) -> DataFrame:
    """(key, text): the inverse of ``encode``: bytes are joined before they are read as UTF-8, so split characters come back whole.

    A cut inside a character gives U+FFFD for its stray bytes; a null list gives null; an id outside the vocabulary is an error.
    """
    kind = encoded.schema[key].dataType.simpleString()
    return encoded.select(F.col(f"`{key}`"), F.col(f"`{ids}`")).mapInArrow(partial(_decode, path=path), f"id {kind}, text string").withColumnRenamed("id", key)
