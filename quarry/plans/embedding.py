"""Embedding providers: text batches to vectors, called in Arrow batches on executors."""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Provider(Protocol):
    dimensions: int

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class HashProvider:
    """Deterministic vectors without a network: the text's md5 bytes from last to first over 255, then zeros."""

    def __init__(self, dimensions: int = 16):
        self.dimensions = dimensions

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            if not t.strip():
                out.append([0.0] * self.dimensions)
                continue
            v = [b / 255 for b in reversed(hashlib.md5(t.encode()).digest())][: self.dimensions]
            out.append(v + [0.0] * (self.dimensions - len(v)))
        return out


class RemoteProvider:
    """A hosted model behind ``post(model, texts) -> vectors``, or ``post(model, texts, input_type)`` where the model tells documents from queries.
    Texts are cut to the model's length; empty ones are not sent and get zeros; order is kept."""

    def __init__(self, post, model: str, dimensions: int, max_tokens: int = 8191, batch: int = 100, vocabulary: str | None = None, typed: bool = False):
        self.post, self.model, self.dimensions, self.batch, self.typed = post, model, dimensions, batch, typed
        self.max_tokens, self.vocabulary = max_tokens, vocabulary

    def cut(self, text: str) -> str:
        """By tokens of a vocabulary file, if there is one; otherwise by 3.5 characters a token."""
        return truncate_tokens(text, self.max_tokens, self.vocabulary) if self.vocabulary else text[: int(self.max_tokens * 3.5)]

    def embed_batch(self, texts: list[str], input_type: str = "document") -> list[list[float]]:
        if input_type not in ("document", "query"):
            raise ValueError("input_type must be document or query")
        full = [k for k, t in enumerate(texts) if t.strip()]
        out = [[0.0] * self.dimensions for _ in texts]
        for a in range(0, len(full), self.batch):
            part = full[a : a + self.batch]
            asked = (self.model, [self.cut(texts[k]) for k in part], *([input_type] if self.typed else []))
            for k, v in zip(part, self.post(*asked), strict=True):
                out[k] = v
        return out


@functools.cache
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    words = r"""'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}]?+\p{L}++|\p{N}{1,3}+| ?[^\s\p{L}\p{N}]++[\r\n]*+|\s++$|\s*[\r\n]|\s+(?!\S)|\s"""
    return tiktoken.Encoding("cut", pat_str=words, mergeable_ranks=ranks, special_tokens={})


def truncate_tokens(text: str, most: int, vocabulary: str) -> str:
    """The longest beginning of at most ``most`` tokens that ends between characters. vocabulary: a file of byte pairs with their ranks."""
    if len(text.encode()) <= most:
        return text
    encoding = _encoding(vocabulary)
    ids = encoding.encode_ordinary(text)
    return text if len(ids) <= most else encoding.decode_bytes(ids[:most]).decode("utf-8", "ignore")


#: Lengths of vectors by model.
DIMENSIONS = {"text-embedding-3-small": 1536, "text-embedding-3-large": 3072, "text-embedding-ada-002": 1536, "voyage-code-3": 1024, "voyage-3": 1024}


def create_provider(kind: str, post=None, model: str | None = None, **options) -> Provider:
    if kind == "hash":
        return HashProvider(**options)
    if kind in ("openai", "voyage"):
        name = model or ("text-embedding-3-small" if kind == "openai" else "voyage-code-3")
        if post is None:
            raise ValueError(f"{kind} needs a way to call its service")
        return RemoteProvider(post, name, DIMENSIONS[name], max_tokens=8191 if kind == "openai" else 32_000, typed=kind == "voyage", **options)
    raise ValueError(f"unknown provider {kind}")


def embed_query(provider: Provider, text: str) -> list[float]:
    """A query's vector, asked for as one where the provider tells queries from documents."""
    return provider.embed_batch([text], "query")[0] if getattr(provider, "typed", False) else provider.embed_batch([text])[0]


def embed(rows: DataFrame, provider: Provider, content: str = "content", batch: int = 1000) -> DataFrame:
    """Add ``embedding`` and ``norm``."""
    where = rows.columns.index(content)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                v = provider.embed_batch([t or "" for t in part.column(where).to_pylist()])
                a = np.array(v, np.float32).reshape(part.num_rows, provider.dimensions)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * provider.dimensions, pa.int32()), pa.array(a.ravel()))
                norms = pa.array(np.sqrt((a.astype(np.float64) ** 2).sum(1)))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, norms], names=[*part.schema.names, "embedding", "norm"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("embedding", "norm"))
    return rows.drop("embedding", "norm").mapInArrow(run, kinds + ", embedding array<float>, norm double")


def xxh64(content: Column) -> Column:
    """The content's 64-bit xxHash with seed 0 in hex. Spark's own function has another seed, so this one is a pandas UDF."""
    import xxhash

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else xxhash.xxh64(t.encode()).hexdigest())

    return run(content)
