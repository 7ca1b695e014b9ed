"""Cutting text into fragments by centroid and drift."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.hashing import fragment_hash
from threadloom.functions.text import normalize_markdown, semantic_noise, strip_code
from threadloom.operators.embed import embed_text

THRESHOLD = 0.75
MAX_DRIFT = 0.25


def paragraphs(units: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, pos, paragraph): parts between blank lines, without blank and noise ones."""
    parts = units.select(*keys, F.posexplode(F.split(text, r"\r?\n\r?\n")).alias("pos", "raw"))
    trimmed = parts.withColumn("paragraph", F.regexp_replace("raw", r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    return trimmed.filter((F.col("paragraph") != "") & ~semantic_noise("paragraph")).drop("raw")


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    norm = np.linalg.norm(a) * np.linalg.norm(b)
    value = float(a @ b / norm) if norm else 0.0
    return value if np.isfinite(value) else 0.0


def fold(vectors: list[np.ndarray], threshold: float = THRESHOLD, drift: float = MAX_DRIFT) -> list[tuple[list[int], float, np.ndarray]]:
    """(members, confidence, centroid) of each chunk: the next paragraph joins while it is closer than `threshold` to the running mean and drifts
    less than `drift` from the chunk's first vector. A chunk's confidence is 1 - the similarity that ended it; the last takes the last similarity computed, 1 if none."""
    chunks: list[tuple[list[int], float, np.ndarray]] = []
    members: list[int] = []
    centroid = first = np.zeros(0)
    last = 1.0
    for i, v in enumerate(vectors):
        if members:
            last = _cosine(centroid, v)
            if last > threshold and 1 - _cosine(first, v) < drift:
                centroid = (centroid * len(members) + v) / (len(members) + 1)
                members.append(i)
                continue
            chunks.append((members, 1 - last, centroid))
        members, centroid, first = [i], v, v
    if members:
        chunks.append((members, 1 - last, centroid))
    return chunks


def chunk(parts: DataFrame, key: str, threshold: float = THRESHOLD, drift: float = MAX_DRIFT) -> DataFrame:
    """(key, fragment_order, text, confidence, centroid, n_parts) of units given as rows (key, pos, paragraph, embedding).

    The fold's state depends on its resets, so a unit (the text of one message part) is folded in one step over Arrow batches. Order is by
    pos from 1; paragraphs of a chunk are joined by a blank line.
    """
    grouped = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "paragraph", "embedding"))).alias("p"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "fragment_order", "text", "confidence", "centroid", "n_parts"]
        for batch in batches:
            rows = []
            for k, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for order, (members, conf, mean) in enumerate(fold([np.array(x["embedding"], float) for x in p], threshold, drift), 1):
                    rows.append((k, order, "\n\n".join(p[i]["paragraph"] for i in members), conf, mean.tolist(), len(members)))
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            kinds = [batch.schema.field(0).type, pa.int32(), pa.string(), pa.float64(), pa.list_(pa.float64()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    kind = parts.schema[key].dataType.simpleString()
    return grouped.mapInArrow(run, f"`{key}` {kind}, fragment_order int, text string, confidence double, centroid array<double>, n_parts int")


def fragment_messages(messages: DataFrame, key: str, text: str, mode: str = "faithful", model=None, threshold: float = THRESHOLD) -> DataFrame:
    """Fragments of messages: code stripped, Markdown normalised, noise dropped, each with order, confidence, hash and vector.

    mode "faithful" normalises first, which leaves one paragraph and so one fragment of confidence 0 per text; "paragraph" splits first and
    folds the paragraphs. Null and noise texts give no fragment.
    """
    cleaned = messages.select(key, strip_code(text).alias("text")).filter("text is not null")
    if mode == "faithful":
        flat = cleaned.select(key, normalize_markdown("text").alias("text")).filter(~semantic_noise("text"))
        out = embed_text(flat.select(key, F.lit(1).alias("fragment_order"), "text", F.lit(0.0).alias("confidence")), "text", model=model)
    elif mode == "paragraph":
        parts = paragraphs(cleaned, [key], "text").withColumn("paragraph", normalize_markdown("paragraph")).filter(~semantic_noise("paragraph"))
        folded = chunk(embed_text(parts, "paragraph", model=model), key, threshold)
        out = folded.select(key, "fragment_order", "text", "confidence", F.col("centroid").cast("array<float>").alias("embedding"))
    else:
        raise ValueError("mode is faithful or paragraph")
    return out.withColumn("hash", fragment_hash(key, "fragment_order", "text"))


def fragment_units(units: DataFrame, message: str, mode: str = "faithful", model=None, threshold: float = THRESHOLD) -> DataFrame:
    """(message, unit_pos, fragment_order, text, confidence, embedding, hash) of text units (message, unit_pos, text).

    Each unit is cut by itself, with orders from 1; hash is that of message, order and text.
    """
    keyed = units.select(F.concat_ws(":", message, "unit_pos").alias("__unit"), "text")
    cut_up = fragment_messages(keyed, "__unit", "text", mode, model, threshold).drop("hash")
    part = F.split("__unit", ":")
    kind = units.schema[message].dataType.simpleString()
    out = cut_up.withColumns({message: part[0].cast(kind), "unit_pos": part[1].cast("int")}).drop("__unit")
    return out.withColumn("hash", fragment_hash(message, "fragment_order", "text"))
