"""Model providers: an interface for embeddings, reranking and answers, and a deterministic offline one."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    """What the retrieval operators ask of a model."""

    name: str
    dimensions: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]: ...

    def answer(self, query: str, context: str) -> str: ...


class Refused(Exception):
    """A call that must not be tried again (bad request or not allowed)."""


def with_retry(call: Callable, tries: int = 3, sleep: float = 1.0):
    """Call again after errors, waiting longer each time; refusals are raised at once."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Refused:
            raise
        except Exception:
            if attempt == tries:
                raise
            time.sleep(sleep * attempt)


class HashProvider:
    """Offline provider: signed hashes of words and character pairs, unit length; the space seeds separate vector spaces."""

    def __init__(self, dimensions: int = 64, space: str = "text") -> None:
        self.dimensions, self.space = dimensions, space
        self.name = f"hash-{space}-{dimensions}"

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(self.dimensions)
            low = (text or "").lower()
            for token in [*low.split(), *(low[i:i + 2] for i in range(len(low) - 1))]:
                h = int.from_bytes(hashlib.sha1(f"{self.space}:{token}".encode()).digest()[:8], "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
        return out

    def rerank(self, query: str, texts: Sequence[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set((t or "").lower().split())) / max(1, len(wanted)) for t in texts]

    def answer(self, query: str, context: str) -> str:
        return context


def embed_documents(docs: DataFrame, provider: Provider, id_col: str = "doc_id", text_col: str = "text", batch: int = 10, tries: int = 3) -> DataFrame:
    """(id, embedding, embedding_model, embedding_dim): texts embedded `batch` to a request inside the tasks; sizes are verified."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            vectors: list[list[float]] = []
            texts = rows[text_col].fillna("").tolist()
            for lo in range(0, len(texts), batch):
                some = texts[lo:lo + batch]
                got = with_retry(lambda some=some: provider.embed(some), tries)
                if len(got) != len(some) or any(len(v) != provider.dimensions for v in got):
                    raise ValueError("the provider returned other vectors than asked for")
                vectors += got
            yield pd.DataFrame({id_col: rows[id_col], "embedding": vectors, "embedding_model": provider.name, "embedding_dim": provider.dimensions})

    return docs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>, embedding_model string, embedding_dim int")
