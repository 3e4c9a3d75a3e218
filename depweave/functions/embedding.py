"""Vectors of nodes for semantic search.

The default embedder hashes words and their trigrams into a fixed number of dimensions; any function from a list of texts to a matrix can take its place.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Dimensions, kinds that are embedded, characters of a symbol's content that are.
DIMENSIONS, KINDS, CONTENT = 384, ["function", "class", "method", "class_method", "file"], 500

Embedder = Callable[[list[str]], np.ndarray]


def hashed(texts: list[str]) -> np.ndarray:
    """Rows of length one, or zero for a text without words."""
    out = np.zeros((len(texts), DIMENSIONS))
    for row, text in zip(out, texts, strict=True):
        for word in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", text):
            word = word.lower()
            for part, weight in [(word, 1.0), *[(f"_{word}_"[k : k + 3], 0.3) for k in range(len(word))]]:
                h = zlib.crc32(part.encode())
                row[h % DIMENSIONS] += weight if h >> 31 else -weight
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm, norm, 1)


def vector(text: str, embedder: Embedder = hashed) -> list[float]:
    return [float(x) for x in embedder([text])[0]]


def text(kind: Column, name: Column, path: Column, content: Column) -> Column:
    """What of a node is embedded: a file's name and path, a symbol's name and the beginning of its content."""
    rest = F.when(kind == "file", path).otherwise(F.substring(content, 1, CONTENT))
    return F.trim(F.concat_ws(" ", name, rest))


def index(nodes: DataFrame, embedder: Embedder = hashed) -> DataFrame:
    """(node_id, embedding) of files, functions, classes and methods."""
    rows = nodes.where(F.col("kind").isin(KINDS)).select("node_id", text(F.col("kind"), F.col("name"), F.col("file_path"), F.col("content")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = embedder(batch["text"].fillna("").tolist()).astype(np.float32)
            yield pd.DataFrame({"node_id": batch["node_id"], "embedding": list(found)})

    return rows.mapInPandas(run, "node_id string, embedding array<float>")
