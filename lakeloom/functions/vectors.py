"""Vector functions."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeloom.functions.text import TARGET_TOKENS

LEAST_CHARS = 200


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either is null, empty, zero, of another length or holds a null."""
    length = norm(a) * norm(b)
    value = F.when((F.size(a) == F.size(b)) & (length > 0), dot(a, b) / length)
    return F.coalesce(value, F.lit(0.0))


class Embedder(Protocol):
    """A model: texts to vectors of one length."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """A deterministic stand-in: hashed words, signed, normalised to length one."""

    def __init__(self, dims: int = 64):
        self.dims = dims

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dims))
        for row, text in zip(out, texts, strict=True):
            for word in text.lower().split():
                h = zlib.crc32(word.encode())
                row[h % self.dims] += 1 if h >> 16 & 1 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


class TooLarge(Exception):
    """A model refused a text; it may have said how many tokens it counted."""

    def __init__(self, tokens: int | None = None):
        super().__init__(f"too large: {tokens} tokens")
        self.tokens = tokens


def shortened(text: str, tokens: int | None) -> str:
    """A refused text, cut to what its token count allows, but to no less than LEAST_CHARS, else to a half; behind a full
    stop, at a line's end or at a space near there. Always shorter than before."""
    size = len(text) // 2 if not tokens or tokens <= 0 else max(LEAST_CHARS, len(text) * TARGET_TOKENS // tokens)
    size = size if size < len(text) else len(text) // 2
    for sign, near, keep in ((".", 80, 1), ("\n", 80, 0), (" ", 40, 0)):
        if (at := text.rfind(sign, max(0, size - near), size + 1 - keep)) > 0:
            return text[: at + keep]
    return text[:size]


class Resilient:
    """An embedder that tries texts which the model refuses again, shortened; the others of a batch go on as they are."""

    def __init__(self, embedder: Embedder):
        self.embedder = embedder

    def __call__(self, texts: list[str]) -> np.ndarray:
        try:
            return np.asarray(self.embedder(texts))
        except TooLarge as refused:
            if len(texts) > 1:
                return np.concatenate([self([t]) for t in texts])
            if len(texts[0]) < 2:
                raise
            return self([shortened(texts[0], refused.tokens)])


def embed(text: Column, embedder: Embedder) -> Column:
    """array<double>, in Arrow batches; the model is set up once a task. Null texts give null."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            vectors = embedder([t or "" for t in b])
            yield pd.Series([None if t is None else v for t, v in zip(b, vectors, strict=True)])

    return run(text)
