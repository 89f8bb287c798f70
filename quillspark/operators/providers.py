"""Models behind a small interface, with an offline implementation that is always the same."""

from __future__ import annotations

import hashlib
import json
import math
import time
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...
    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]: ...
    def chat(self, prompt: str) -> str: ...


class ProviderError(RuntimeError):
    """A call failed or gave what it must not."""


class Offline:
    """Unit vectors seeded by the text, a reranker that turns the order round, a fixed answer."""

    def __init__(self, dim: int = 16, answer: str = "{}") -> None:
        self.dim, self.answer = dim, answer

    def embed(self, texts: list[str]) -> list[list[float]]:
        seeds = (int.from_bytes(hashlib.md5(t.encode()).digest()[:8], "big") for t in texts)
        return [np.random.default_rng(s).normal(size=self.dim).tolist() for s in seeds]

    def rerank(self, query: str, texts: list[str]) -> list[tuple[int, float]]:
        return [(i, (i + 1) / len(texts)) for i in reversed(range(len(texts)))]

    def chat(self, prompt: str) -> str:
        return self.answer


def checked_vectors(vectors: list[list[float]], n: int, dim: int | None = None) -> list[list[float]]:
    """The vectors at length 1; an error for a wrong number, length, value or a zero vector."""
    if len(vectors) != n:
        raise ProviderError(f"{len(vectors)} vectors for {n} texts")
    out = []
    for v in vectors:
        norm = math.sqrt(sum(x * x for x in v))
        if (dim and len(v) != dim) or len(v) != len(vectors[0]) or not math.isfinite(norm) or norm == 0:
            raise ProviderError("a vector has a wrong length or value")
        out.append([x / norm for x in v])
    return out


def checked_ranks(pairs: list[tuple[int, float]], n: int) -> list[float]:
    """Scores in the order of the texts; an error for an index out of range, repeated or missing."""
    if sorted(i for i, _ in pairs) != list(range(n)) or not all(math.isfinite(s) for _, s in pairs):
        raise ProviderError("ranks do not match the texts")
    return [s for _, s in sorted(pairs)]


def retried(call: Callable[[], object], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> object:
    """The call's result; after a failure it is tried again, waiting twice as long each time."""
    for k in range(tries):
        try:
            return call()
        except (ConnectionError, TimeoutError, ProviderError):
            if k + 1 == tries:
                raise
            sleep(wait * 2**k)
    raise AssertionError("unreachable")


def embed(rows: DataFrame, provider: Provider, text: str = "text", batch: int = 32, dim: int | None = None) -> DataFrame:
    """``rows`` with ``embedding``; each task calls the provider for ``batch`` texts at a time."""
    names = rows.columns

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found: list[list[float]] = []
            for a in range(0, len(part), batch):
                own = part[text].iloc[a : a + batch].tolist()
                found += retried(lambda own=own: checked_vectors(provider.embed(own), len(own), dim))
            yield part[names].assign(embedding=found)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{ddl}, embedding array<double>")


class QueryCache:
    """Query vectors by model and text, the least recently used dropped first; with a path, kept in a file."""

    def __init__(self, size: int = 256, path: str | None = None) -> None:
        self.size, self.path, self.rows = size, path, {}
        try:
            told = json.loads(Path(path).read_text(encoding="utf-8")) if path else []
            self.rows = {(r["model"], r["text"]): [float(x) for x in r["vector"]] for r in told}
        except (OSError, ValueError, KeyError, TypeError):
            self.rows = {}  # a file that is missing or broken is an empty cache

    def get(self, model: str, text: str, make: Callable[[], list[float]]) -> list[float]:
        key = (model, text)
        known = key in self.rows
        self.rows[key] = found = self.rows.pop(key) if known else make()
        while len(self.rows) > self.size:
            del self.rows[next(iter(self.rows))]
        if self.path and not known:
            from .files import write_results

            write_results(self.path, [{"model": m, "text": t, "vector": v} for (m, t), v in self.rows.items()])
        return found
