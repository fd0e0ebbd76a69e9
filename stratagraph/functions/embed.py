"""Text vectors. A provider is any function from texts to vectors; the default hashes words.

The default needs no model: words and pairs of neighbouring words are hashed into a fixed number
of signed buckets and the vector is scaled to length one, the same in every process.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..core import bounded_batches, release

WIDTH = 128
_WORD = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]")


def hash_embed(texts: list[str], width: int = WIDTH) -> np.ndarray:
    out = np.zeros((len(texts), width), np.float32)
    for k, t in enumerate(texts):
        words = [w.lower().encode() for w in _WORD.findall(t or "")]
        codes = np.array([zlib.crc32(w) for w in words] + [zlib.crc32(a + b" " + b) for a, b in zip(words, words[1:])], np.int64)
        if len(codes):
            np.add.at(out[k], codes % width, np.where(codes >> 16 & 1, 1.0, -1.0))
            size = np.linalg.norm(out[k])
            out[k] /= size or 1
    return out


def embed_column(text: str, provider: Callable[[list[str]], np.ndarray] = hash_embed) -> Column:
    session = SparkSession.getActiveSession()
    if session is not None:
        bounded_batches(session)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for values in batches:
            yield pd.Series(list(provider([v or "" for v in values])))
        release()

    return run(F.col(text))


def embed_query(query: str) -> list[float]:
    return hash_embed([query])[0].astype(float).tolist()
