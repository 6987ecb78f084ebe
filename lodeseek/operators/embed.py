"""Vectors of texts by a function that the caller gives, some texts at a time."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame

#: Texts that a provider gets at once.
BATCH = 32


def embedded(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], text: str = "text", out: str = "embedding", batch: int = BATCH) -> DataFrame:
    """rows with the vector of each text; a null or blank text has none and isn't sent."""

    def run(frames):
        for f in frames:
            texts = f[text].tolist()
            asked = [i for i, t in enumerate(texts) if isinstance(t, str) and t.strip()]
            vectors: list = [None] * len(texts)
            for at in range(0, len(asked), batch):
                part = asked[at : at + batch]
                got = provider([texts[i] for i in part])
                if len(got) != len(part):
                    raise ValueError("the provider gave another number of vectors than of texts")
                for i, v in zip(part, got):
                    vectors[i] = [float(x) for x in v]
            yield f.assign(**{out: pd.Series(vectors, index=f.index, dtype=object)})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != out)
    return rows.drop(out).mapInPandas(run, f"{kinds}, `{out}` array<float>")


def hashed(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A provider without a model: signed counts of hashed words, of length 1. For tests and for texts that share words."""

    def provider(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return provider
