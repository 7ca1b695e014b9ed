"""Text to vectors: a pluggable model behind an Arrow-batched step, with a deterministic feature-hashing default."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from threadloom.errors import EngineError

DIM = 64
_TOKEN = re.compile(r"\w+")


def hashing_embedder(dim: int = DIM) -> Callable[[list[str]], list[np.ndarray]]:
    """Signed feature hashing of lower-case tokens, scaled to unit length; a text without tokens gives zeros."""

    def embed(texts: list[str]) -> list[np.ndarray]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for token in _TOKEN.findall(text.lower()):
                h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = np.linalg.norm(v)
            out.append(v / norm if norm else v)
        return out

    return embed


def embed_text(df: DataFrame, text: str, out: str = "embedding", model: Callable[[list[str]], list] | None = None) -> DataFrame:
    """`df` with the vector of each text. The model gets one list per Arrow batch and must answer in order; too few answers raise
    an error (NULL_EMBEDDINGS). A null text gets a null vector."""
    model, df = model or hashing_embedder(), df.drop(out)
    names, at = [*df.columns, out], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            asked = [t for t in texts if t is not None]
            got = model(asked) if asked else []
            if len(got) != len(asked):
                raise EngineError("the embedding model gave no answer for some texts", "NULL_EMBEDDINGS", 400)
            answers = iter(got)
            vectors = [None if t is None else [float(x) for x in next(answers)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vectors, pa.list_(pa.float32()))], names)

    schema = StructType([*df.schema.fields, StructField(out, ArrayType(FloatType()))])
    return df.mapInArrow(run, schema)


def embed_query(query: str, model: Callable[[list[str]], list] | None = None) -> list[float]:
    return [float(x) for x in (model or hashing_embedder())([query])[0]]


__all__ = ["DIM", "embed_query", "embed_text", "hashing_embedder"]
