"""Interfaces to models and services, with deterministic offline defaults.

Nothing here calls a network. A provider of your own has the same methods; no parity with any model is claimed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class LanguageModel(Protocol):
    def generate(self, prompt: str) -> str: ...


class Embedder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class Reranker(Protocol):
    def scores(self, query: str, documents: list[str]) -> list[float]: ...


class Entailment(Protocol):
    def scores(self, context: str, claims: list[str]) -> list[float]: ...


class Parser(Protocol):
    def parse(self, content: bytes, name: str) -> list[dict]: ...


class Scripted:
    """A language model that gives its answers in turn, the last one again and again; nothing to say is an empty text."""

    def __init__(self, answers: list[str]) -> None:
        self.answers, self.prompts = list(answers), []

    def generate(self, prompt: str) -> str:
        self.prompts.append(prompt)
        return (self.answers.pop(0) if len(self.answers) > 1 else self.answers[0]) if self.answers else ""


class HashedShingles:
    """Texts as unit vectors of hashed three-character pieces; an empty text is the zero vector."""

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        import xxhash

        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            s = " ".join((t or "").lower().split())
            for j in range(max(1, len(s) - 2) if s else 0):
                h = xxhash.xxh3_64_intdigest(s[j : j + 3])
                out[i, h % self.dim] += 1.0 if h >> 63 else -1.0
        n = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, n, out=out, where=n > 0)


class WordOverlap:
    """Share of the query's words that a document has; stands in for a reranker and for entailment."""

    def scores(self, query: str, documents: list[str]) -> list[float]:
        q = set(query.lower().split())
        return [len(q & set((d or "").lower().split())) / len(q) if q else 0.0 for d in documents]


def embed(text: Column, provider: Embedder, batch: int = 32, longest: int = 3800) -> Column:
    """Vectors of a text column in batches, texts cut to ``longest`` words; null texts give the vector of an empty one."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts = [" ".join((t or "").split()[:longest]) for t in s]
            out: list = []
            for a in range(0, len(texts), batch):
                out += list(provider.encode(texts[a : a + batch]))
            yield pd.Series(out)

    return run(text)


def valid_text(text: str | None, longest: int = 3800) -> str:
    """A text fit for embedding: not blank, at most ``longest`` words."""
    if not text or not text.strip():
        raise ValueError("blank text")
    w = text.split()
    return text if len(w) <= longest else " ".join(w[:longest])


def safe_batches(texts: list[str], most_words: int, most_texts: int = 100) -> list[list[str]]:
    """Neighbouring texts in batches within both limits; a text over the word limit is alone."""
    out: list[list[str]] = []
    used = 0
    for t in texts:
        n = len(t.split())
        if not out or used + n > most_words or len(out[-1]) >= most_texts:
            out.append([])
            used = 0
        out[-1].append(t)
        used += n
    return out
