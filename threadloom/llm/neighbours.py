"""Most similar vectors for every vector (problem 7).

Vectors are scaled to unit length, so that the greatest inner product is the greatest cosine. An index is fitted on a bounded sample:
coarse centroids split the collection into lists, and a product code of 4 bits per subspace describes what a vector adds to its
centroid. Codes are chosen for the score, not the distance: the part of the residual parallel to the vector is punished
`eta` times as much as the rest (score-aware anisotropic quantisation). Every row is indexed.

A query scans the codes of its `probes` nearest lists by table look-up (two subspaces a byte) and ranks the best of each list
again by exact cosine; the best k of all lists remain. There are sqrt(n) lists, and beyond 67 million rows one for each `block` rows, so
that a list stays within a block. 64 lists are scanned, or a tenth where that is more, since recall follows the share of lists: with a fixed
number the work would grow with the number of queries alone, but recall would fall as the table grows.

Vectors are read and scaled once. Each goes to one cell (list, block of the list) and each query to the cells of its lists; a cell's
vectors come first in its sorted partition and its queries stream past them, so neither is copied for the other and a cell holds no more
than a block in memory. Equal vectors fall in one block, where they are scanned and reranked as one and then stand for their smallest
ids, so copies take one place however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadloom.session import cut

SAMPLE = 20_000  # rows the index is fitted on, or 16 for each list where that is more
MOST_LISTS = 25_000  # reached at 200 million rows; beyond it lists have more than one block
BLOCK = 8_192  # vectors of a list in one cell
PROBES = 64  # lists a query scans, or a tenth of them where that is more
DEPTH = 32  # reranked per cell and query
QUERIES = 128  # scanned together
FOUND = "query_id bigint, other_id bigint, cosine double"


def unit_rows(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, unit vectors) of a list<float> column: which rows have `dim` finite elements, none null, not all zero; scaled in double precision."""
    sizes = np.asarray(column.value_lengths().fill_null(-1))
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    top = np.abs(flat).max(1, initial=0.0)  # NaN and null give NaN
    fine = np.isfinite(top) & (top > 0)
    flat = flat[fine] / top[fine, None]
    return rows[fine], (flat / np.linalg.norm(flat, axis=1, keepdims=True)).astype(np.float32)


def packed(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    width = m.shape[1] * m.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(m), [None, pa.py_buffer(np.ascontiguousarray(m))]).cast(pa.binary())


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _in_parts(rows: int, lists: int) -> Iterator[slice]:
    """Slices of rows whose scores against all lists fit a small matrix."""
    step = max(1, (1 << 23) // max(1, lists))
    return (slice(at, at + step) for at in range(0, rows, step))


def _means(sample: np.ndarray, lists: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids on the unit sphere. More than 512 are found in two levels, so that the fit costs sample * sqrt(lists)."""
    n = len(sample)
    lists = max(1, min(lists, n))
    first = lists if lists <= 512 else round(lists**0.5)
    c = sample[rng.choice(n, first, replace=False)].copy()
    for _ in range(rounds):
        at = np.argmax(sample @ c.T, 1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, sample)
        size = np.linalg.norm(sums, axis=1)
        c[size > 0] = sums[size > 0] / size[size > 0, None]
        if (size == 0).any():
            c[size == 0] = sample[rng.choice(n, int((size == 0).sum()))]
    if first == lists:
        return c
    at = np.argmax(sample @ c.T, 1)
    own = [sample[at == j] for j in range(first)]
    return np.concatenate([_means(x, max(1, min(512, round(lists * len(x) / n))), rounds, rng) for x in own if len(x)])


class AnisotropicIndex:
    """Coarse centroids and anisotropic 4-bit product codes of unit vectors."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float = 0.2, rounds: int = 8, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        n, self.dim = sample.shape
        self.eta = max(1.0, (self.dim - 1) * threshold**2 / (1 - threshold**2))
        self.centroids = c = _means(sample, lists, rounds, rng)
        at = self.assign(sample)
        self.pairs = self.dim // 2 + self.dim % 2  # subspaces of two dimensions
        self.bytes = self.pairs // 2 + self.pairs % 2
        x, r = self._padded(sample), self._padded(sample - c[at])
        self.books = np.stack([r[rng.choice(n, 16, replace=n < 16), m] for m in range(self.pairs)])
        codes = self._nearest(r)
        for _ in range(3):
            codes = self._sweep(x, r, codes)
            self._refit(x, r, codes)

    def _padded(self, x: np.ndarray) -> np.ndarray:
        if self.dim % 2:
            x = np.pad(x, ((0, 0), (0, 1)))
        return x.reshape(len(x), self.pairs, 2)

    def _nearest(self, r: np.ndarray) -> np.ndarray:
        return np.stack([np.argmin(((r[:, m, None] - self.books[m]) ** 2).sum(2), 1) for m in range(self.pairs)], 1)

    def _sweep(self, x: np.ndarray, r: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Each subspace's code in turn, the one of least anisotropic loss given the others."""
        codes = codes.copy()
        left = np.stack([((r[:, m] - self.books[m][codes[:, m]]) * x[:, m]).sum(1) for m in range(self.pairs)], 1)
        total = left.sum(1)
        for m in range(self.pairs):
            rest = total - left[:, m]
            diff = r[:, m, None] - self.books[m]
            par = (diff * x[:, m, None]).sum(2)
            best = np.argmin((diff**2).sum(2) + (self.eta - 1) * (rest[:, None] + par) ** 2, 1)
            codes[:, m] = best
            left[:, m] = par[np.arange(len(r)), best]
            total = rest + left[:, m]
        return codes

    def _refit(self, x: np.ndarray, r: np.ndarray, codes: np.ndarray) -> None:
        """Each codeword as the least-squares solution of the loss of the vectors that use it."""
        left = np.stack([((r[:, m] - self.books[m][codes[:, m]]) * x[:, m]).sum(1) for m in range(self.pairs)], 1)
        total = left.sum(1)
        for m in range(self.pairs):
            want = (total - left[:, m] + (r[:, m] * x[:, m]).sum(1))[:, None] * x[:, m] * (self.eta - 1) + r[:, m]
            for k in range(16):
                own = codes[:, m] == k
                if own.sum() >= 3:
                    xs = x[own, m]
                    self.books[m][k] = np.linalg.solve(own.sum() * np.eye(2) + (self.eta - 1) * xs.T @ xs, want[own].sum(0))

    def assign(self, v: np.ndarray) -> np.ndarray:
        """The list of each unit vector."""
        return np.concatenate([np.argmax(v[part] @ self.centroids.T, 1) for part in _in_parts(len(v), len(self.centroids))] or [np.zeros(0, np.int64)])

    def encode(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(list, packed codes) of unit vectors; two subspaces share a byte."""
        at = self.assign(v)
        x, r = self._padded(v), self._padded(v - self.centroids[at])
        codes = self._sweep(x, r, self._nearest(r)).astype(np.uint8)
        if self.pairs % 2:
            codes = np.pad(codes, ((0, 0), (0, 1)))
        return at.astype(np.int32), codes[:, 0::2] * 16 + codes[:, 1::2]

    def probe(self, q: np.ndarray, probes: int) -> np.ndarray:
        probes = min(probes, len(self.centroids))
        best = [np.argpartition(-(q[part] @ self.centroids.T), probes - 1, 1)[:, :probes] for part in _in_parts(len(q), len(self.centroids))]
        return np.concatenate(best or [np.zeros((0, probes), np.int64)])

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, bytes * 256) look-up tables of the scores that a code byte adds."""
        t = np.einsum("qmd,mkd->qmk", self._padded(q), self.books)
        if self.pairs % 2:
            t = np.pad(t, ((0, 0), (0, 1), (0, 0)))
        return (t[:, 0::2, :, None] + t[:, 1::2, None, :]).reshape(len(q), -1).astype(np.float32)

    def scan(self, lst: int, q: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Approximate scores (queries, vectors) of the vectors of one list."""
        at = codes.T.astype(np.intp) + np.arange(self.bytes)[:, None] * 256
        lut, out = self.tables(q), np.repeat((q @ self.centroids[lst])[:, None], len(codes), 1)
        for i in range(len(q)):
            out[i] += lut[i][at].sum(0)
        return out


def _copies(vectors: np.ndarray, ids: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first row of each distinct vector, its `most` smallest ids in order, and which places of these are filled."""
    flat = np.ascontiguousarray(vectors + np.float32(0)).view(np.dtype((np.void, vectors.shape[1] * 4))).ravel()  # -0.0 is 0.0
    group = np.unique(flat, return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    first = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    nth = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    kept = nth < most
    members = np.zeros((len(first), nth[kept].max() + 1), np.int64)
    there = np.zeros(members.shape, bool)
    at = group[order][kept], nth[kept]
    members[at], there[at] = ids[order][kept], True
    return order[first], members, there


class _Cell:
    """The vectors of one cell, ready for its queries."""

    def __init__(self, index: AnisotropicIndex, lst: int, ids: np.ndarray, codes: np.ndarray, vectors: np.ndarray, k: int, depth: int | None) -> None:
        self.index, self.lst, self.k, self.depth = index, lst, k, depth
        # The query's own vector may take a place of its own: one more is kept of everything.
        rows, self.members, self.filled = _copies(vectors, ids, k + 1)
        self.vectors, self.codes = vectors[rows], codes[rows]

    def best(self, own: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, other id, cosine) of the k best for each query."""
        scores = self.index.scan(self.lst, q, self.codes) if self.depth else q @ self.vectors.T
        keep = min((self.depth or self.k + DEPTH) + 1, len(self.vectors))
        near = np.argpartition(-scores, keep - 1, 1)[:, :keep]
        exact = np.einsum("qcd,qd->qc", self.vectors[near].astype(np.float64), q.astype(np.float64))
        order = np.lexsort((self.members[near, 0], -exact), axis=1)[:, : self.k + 1]
        pick = np.take_along_axis(near, order, 1)
        other = self.members[pick].reshape(len(q), -1)
        value = np.repeat(np.take_along_axis(exact, order, 1), self.members.shape[1], 1)
        value[~self.filled[pick].reshape(len(q), -1) | (own[:, None] == other)] = -np.inf
        order = np.lexsort((other, -value), axis=1)[:, : self.k]
        other, value = np.take_along_axis(other, order, 1), np.take_along_axis(value, order, 1)
        there = np.isfinite(value)
        return np.repeat(own[:, None], order.shape[1], 1)[there], other[there], value[there]


def _scan(held, k: int, depth: int | None):
    """A pass over partitions sorted by (list, b, side): a cell's vectors (side 0) are gathered, its queries (side 1) stream past them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value[0]
        now, parts, cell = None, [], None
        for batch in batches:
            lists, blocks, sides = (batch.column(c).to_numpy() for c in range(3))
            ids = batch.column(3).to_numpy()
            turns = np.flatnonzero(np.r_[True, (np.diff(lists) != 0) | (np.diff(blocks) != 0) | (np.diff(sides) != 0)]) if len(ids) else []
            out = []
            for a, b in zip(turns, [*turns[1:], len(ids)]):
                if now != (lists[a], blocks[a]):
                    now, parts, cell = (lists[a], blocks[a]), [], None
                vectors = unpacked(batch.column(5).slice(a, b - a), np.float32, index.dim)
                if sides[a] == 0:
                    parts.append((ids[a:b], unpacked(batch.column(4).slice(a, b - a), np.uint8, index.bytes), vectors))
                    continue
                if cell is None and parts:
                    cell = _Cell(index, int(lists[a]), *(np.concatenate(x) for x in zip(*parts)), k, depth)
                    parts = []
                if cell is not None:
                    out += [cell.best(ids[a:b][at : at + QUERIES], vectors[at : at + QUERIES]) for at in range(0, b - a, QUERIES)]
            columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["query_id", "other_id", "cosine"])

    return run


def nearest(
    rows: DataFrame, key: str, embedding: str, queries: DataFrame | None = None, k: int = 10, dim: int = 128,
    sample_rows: int = SAMPLE, probes: int | None = None, depth: int = DEPTH, lists: int | None = None, block: int = BLOCK, exact: bool = False,
) -> DataFrame:
    """(query_id, other_id, cosine, place) of the `k` other rows most similar by cosine to each query row.

    `queries` has the column `key`; None asks for every row. Rows whose vector is null, not of `dim` elements, all zero or not finite
    take no part on either side. `probes` is the number of lists scanned (PROBES, or a tenth of the lists). Equal vectors are neighbours of each other; equal cosines are ordered by id. Fewer than k
    other rows give fewer neighbours; an empty table gives none. The sample (`sample_rows`, or 16 rows a list) bounds only the fit. With
    `exact` every query meets every block by exact cosine: the way to results without loss, and what recall is measured against.
    """
    spark = rows.sparkSession

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = unit_rows(b.column(1), dim)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), packed(v)], ["id", "vector"])

    given = rows.filter(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(embedding).cast("array<float>").alias("e"))
    good = cut(given.mapInArrow(scaled, "id bigint, vector binary"))
    n = good.count()
    if n == 0:
        return spark.createDataFrame([], FOUND + ", place int")
    n_lists = lists or min(MOST_LISTS, max(round(n**0.5), -(-n // block)))
    sample_rows = max(sample_rows, 16 * n_lists)
    # A hash threshold leaves about 1.5 samples of rows, so the ordering meets few rows however many partitions there are.
    share_of_rows = min(1.0, 1.5 * sample_rows / n)
    near_sample = good.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share_of_rows * (1 << 30)) + 1)
    sample = near_sample.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toArrow()
    unit = unpacked(sample["vector"], np.float32, dim)
    index = AnisotropicIndex(unit, max(1, min(n_lists, len(unit) // 16 or 1)))
    # How many blocks a list needs, from the sample's shares: a bounded table of one number a list.
    share = np.bincount(index.assign(unit), minlength=len(index.centroids)) / len(unit)
    blocks = np.maximum(1, np.ceil(share * n / block)).astype(np.int64)
    held = spark.sparkContext.broadcast((index, blocks))
    probes = len(index.centroids) if exact else probes or max(PROBES, -(-len(index.centroids) // 10))
    names = ["list", "b", "side", "id", "code", "vector"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, blocks = held.value
        for b in batches:
            if b.num_rows:
                v, ids = unpacked(b.column(1), np.float32, dim), b.column(0).to_numpy()
                # More copies than can be neighbours leave at once, so a hot vector does not fill its block.
                rows, members, filled = _copies(v, ids, k + 1)
                v, ids = np.repeat(v[rows], filled.sum(1), 0), members[filled]
                bits = np.ascontiguousarray(v + np.float32(0)).view(np.uint32).astype(np.uint64)
                keys = (bits * (2 * np.arange(dim, dtype=np.uint64) + 0x9E3779B1)).sum(1)
                at, codes = index.encode(v)
                mixed = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = (mixed % blocks[at].astype(np.uint64)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own), pa.array(np.zeros(len(at), np.int8)), pa.array(ids), packed(codes), packed(v)], names)

    def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, blocks = held.value
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # each query becomes `probes` rows
                b = whole.slice(start, 256)
                v, ids = unpacked(b.column(1), np.float32, dim), b.column(0).to_numpy()
                lists = index.probe(v, probes)
                flat, who = lists.ravel(), np.repeat(np.arange(len(ids)), lists.shape[1])
                row = np.repeat(np.arange(len(flat)), blocks[flat])
                nth = np.arange(len(row)) - np.repeat(np.cumsum(blocks[flat]) - blocks[flat], blocks[flat])
                who = who[row]
                yield pa.RecordBatch.from_arrays([pa.array(flat[row].astype(np.int32)), pa.array(nth.astype(np.int32)), pa.array(np.ones(len(row), np.int8)), pa.array(ids[who]), pa.nulls(len(row), pa.binary()), packed(v[who])], names)

    asked = good if queries is None else good.join(queries.select(F.col(key).cast("bigint").alias("id")).distinct(), "id", "left_semi")
    schema = "list int, b int, side tinyint, id bigint, code binary, vector binary"
    cells = good.mapInArrow(coded, schema).unionAll(asked.mapInArrow(asking, schema))
    met = cells.repartition("list", "b").sortWithinPartitions("list", "b", "side")
    found = met.mapInArrow(_scan(held, k, None if exact else depth), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.col("cosine").desc(), "other_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
