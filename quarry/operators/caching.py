"""Caches inside a worker or on the driver, and their measures. Results of queries are cached by Spark (``persist``), not here."""

from __future__ import annotations

import functools
import hashlib
import json
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Hashable
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Counts:
    hits: int = 0
    misses: int = 0
    evicted: int = 0
    expired: int = 0

    @property
    def hit_rate(self) -> float:
        return self.hits / (self.hits + self.misses) if self.hits + self.misses else 0.0


@dataclass
class Cache:
    """The ``most`` entries used last, none older than ``seconds``, of ``most_bytes`` in all if that is given (by ``size_of``)."""

    most: int = 1000
    seconds: float = 3600.0
    most_bytes: int | None = None
    size_of: Callable[[Any], int] = lambda v: len(v) if isinstance(v, (str, bytes)) else 1
    clock: Callable[[], float] = time.time
    counts: Counts = field(default_factory=Counts)

    def __post_init__(self) -> None:
        self._rows: OrderedDict[Hashable, tuple[float, Any]] = OrderedDict()
        self._bytes, self._lock = 0, threading.RLock()

    def __len__(self) -> int:
        return len(self._rows)

    def _drop(self, key: Hashable) -> None:
        self._bytes -= self.size_of(self._rows.pop(key)[1])

    def get(self, key: Hashable, default: Any = None) -> Any:
        with self._lock:
            row = self._rows.get(key)
            if row and self.clock() - row[0] > self.seconds:
                self._drop(key)
                self.counts.expired += 1
                row = None
            if not row:
                self.counts.misses += 1
                return default
            self._rows.move_to_end(key)
            self.counts.hits += 1
            return row[1]

    def put(self, key: Hashable, value: Any) -> None:
        with self._lock:
            if key in self._rows:
                self._drop(key)
            self._rows[key] = (self.clock(), value)
            self._bytes += self.size_of(value)
            while len(self._rows) > self.most or self.most_bytes is not None and self._bytes > self.most_bytes and len(self._rows) > 1:
                self._drop(next(iter(self._rows)))
                self.counts.evicted += 1

    def purge(self) -> int:
        """Drop what is too old; returns how many."""
        with self._lock:
            old = [k for k, (t, _) in self._rows.items() if self.clock() - t > self.seconds]
            for k in old:
                self._drop(k)
            self.counts.expired += len(old)
            return len(old)

    def clear(self) -> None:
        with self._lock:
            self._rows.clear()
            self._bytes, self.counts = 0, Counts()

    def stats(self) -> dict:
        n = len(self._rows)
        return asdict(self.counts) | {"entries": n, "bytes": self._bytes, "hit_rate": self.counts.hit_rate, "average_size": self._bytes / n if n else 0.0}

    def save(self, path: str) -> None:
        with self._lock, open(path, "w", encoding="utf-8") as f:
            json.dump([[k, t, v] for k, (t, v) in self._rows.items()], f)

    def load(self, path: str) -> int:
        """Entries of a saved cache that are not too old; a missing or broken file has none."""
        try:
            with open(path, encoding="utf-8") as f:
                rows = json.load(f)
        except (OSError, ValueError):
            return 0
        before = len(self)
        for key, t, value in rows:
            if self.clock() - t <= self.seconds:
                self.put(key, value)
                self._rows[key] = (t, value)
        return len(self) - before


class Levels:
    """A small cache before a large one: what the large one has moves up."""

    def __init__(self, near: Cache, far: Cache):
        self.near, self.far = near, far

    def get(self, key: Hashable, default: Any = None) -> Any:
        none = object()
        value = self.near.get(key, none)
        if value is none:
            value = self.far.get(key, none)
            if value is not none:
                self.near.put(key, value)
        return default if value is none else value

    def put(self, key: Hashable, value: Any) -> None:
        self.near.put(key, value)
        self.far.put(key, value)

    def stats(self) -> dict:
        near, far = self.near.stats(), self.far.stats()
        asked, found = near["hits"] + near["misses"], near["hits"] + far["hits"]
        return {"near": near, "far": far, "hit_rate": found / asked if asked else 0.0}


def key_of(content: str, path: str | None = None) -> str:
    """SHA-256 of the content, or of that and the path."""
    h = hashlib.sha256(content.encode("utf-8", "surrogatepass")).hexdigest()
    return hashlib.sha256(f"{h}:{path}".encode()).hexdigest() if path else h


def cache_key(content: Column, path: Column | None = None) -> Column:
    """``key_of`` as a column."""
    h = F.sha2(content, 256)
    return h if path is None else F.when(F.coalesce(path, F.lit("")) == "", h).otherwise(F.sha2(F.concat(h, F.lit(":"), path), 256))


def requests(rows: DataFrame, group: list[str], key: str, size: str) -> DataFrame:
    """What a cache that keeps everything would do with rows as requests: first requests miss, all others hit; and the average entry."""
    per = rows.groupBy(*group, key).agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("size"))
    out = per.groupBy(*group).agg(F.sum("n").alias("requests"), F.count(F.lit(1)).alias("misses"), F.round(F.avg("size"), 6).alias("average_size"))
    return out.withColumn("hits", F.col("requests") - F.col("misses")).withColumn("hit_rate", F.round(F.col("hits") / F.col("requests"), 6))


def cached(cache: Cache, key: Callable[..., Hashable] = lambda *a, **k: (a, tuple(sorted(k.items())))):
    """Decorator: results by arguments."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            none = object()
            at = key(*args, **kwargs)
            got = cache.get(at, none)
            if got is none:
                got = f(*args, **kwargs)
                cache.put(at, got)
            return got

        return run

    return wrap


def timed(record: Callable[[str, float, bool], None]):
    """Decorator: tells ``record`` the name, milliseconds and whether it succeeded, of every call."""

    def wrap(f):
        @functools.wraps(f)
        def run(*args, **kwargs):
            began, ok = time.perf_counter(), False
            try:
                out = f(*args, **kwargs)
                ok = True
                return out
            finally:
                record(f.__name__, (time.perf_counter() - began) * 1000, ok)

        return run

    return wrap
