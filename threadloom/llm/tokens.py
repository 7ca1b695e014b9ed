"""Encoding of the corpus with a public byte-level BPE tokenizer (problem 8).

A text is cut into pre-tokens by the tokenizer's public pattern; merges never cross them. A pre-token runs through a streaming
transducer with bounded lookahead: whether a token is final depends only on the next `lookahead` bytes, a number computed from the merge
list alone, so the transducer holds at most lookahead + block bytes, whatever the length of the pre-token. Ids of short pre-tokens
are remembered in a bounded table.

Decoding feeds bytes through an incremental UTF-8 state machine, so ids may arrive in any portions.
"""

from __future__ import annotations

import codecs
import heapq
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The pre-token pattern of the byte_bpe_50k tokenizer (fixed value: public tokenizer).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
TOKENIZERS = "/opt/tokenizers"
TOKENIZER = "byte_bpe_50k.json"
REMEMBERED = 1 << 17
BLOCK = 4096


def _byte_of() -> dict[str, int]:
    """The public byte alphabet: printable Latin-1 stands for itself, the other bytes follow from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBpe:
    """The vocabulary and merges of a byte-level BPE, with its sufficient lookahead."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of()
        raw = lambda s: bytes(byte[c] for c in s)
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in byte for c in s)}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.bytes_of = {i: s for s, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(model["merges"]):
            a, b = (raw(s) for s in (m.split(" ") if isinstance(m, str) else m))
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.lookahead = self._sufficient_lookahead()
        pattern = regex.compile(PATTERN)
        self.find, self.find_one_by_one = pattern.findall, pattern.finditer
        self.known: dict[str, list[int]] = {}

    def _sufficient_lookahead(self) -> int:
        """How many bytes from a token's start on can decide whether it is final.

        far[t] is the greatest distance from the start of token t to a change of the text that can decide whether t is there.
        In order of rank, a merge u+v is decided by a change inside it, by what decides u, or by what decides v, |u| bytes on;
        whatever decides the merge in turn decides whether its parts are still free for later merges.
        """
        far: dict[int, int] = {}
        most = 1
        for (u, v), (_, t) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            lu, lv = len(self.bytes_of[u]), len(self.bytes_of[v])
            reach = max(lu + lv, far.get(u, 0), lu + far.get(v, 0))
            far[u], far[v], far[t] = max(far.get(u, 0), reach), max(far.get(v, 0), reach - lu), max(far.get(t, 0), reach)
            most = max(most, reach)
        return most

    def _merge(self, data: bytes) -> list[int]:
        """The tokens of a bounded piece: merges in order of rank, leftmost first, on a linked list with a heap."""
        tok = [self.single[b] for b in data]
        n = len(tok)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.merges.get
        heap = [(m[0], i, tok[i], tok[i + 1], m[1]) for i in range(n - 1) if (m := get((tok[i], tok[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, t = heapq.heappop(heap)
            j = nxt[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j] = t, -1
            nxt[i] = k = nxt[j]
            if k < n:
                prv[k] = i
                if m := get((t, tok[k])):
                    heapq.heappush(heap, (m[0], i, t, tok[k], m[1]))
            h = prv[i]
            if h >= 0 and (m := get((tok[h], t))):
                heapq.heappush(heap, (m[0], h, tok[h], t, m[1]))
        return [t for t in tok if t >= 0]

    def transduce(self, pieces: Iterable[bytes], block: int = BLOCK) -> Iterator[int]:
        """Tokens of one pre-token that arrives in pieces, each emitted once no further byte can change it."""
        pending = b""
        for piece in pieces:
            pending += piece
            while len(pending) > block + self.lookahead:
                window, stable, used = pending[: block + self.lookahead], block, 0
                for t in self._merge(window):
                    # final if a change at the window's end is farther than the lookahead from the token's start
                    if used > stable - 1:
                        break
                    yield t
                    used += len(self.bytes_of[t])
                pending = pending[used:]
        if pending:
            yield from self._merge(pending)

    def piece(self, s: str) -> list[int]:
        """The ids of one pre-token."""
        known = self.known.get(s)
        if known is not None:
            return known
        ids = list(self.transduce(s[at : at + BLOCK].encode("utf-8", "surrogatepass") for at in range(0, len(s), BLOCK)))
        if len(s) <= 32:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[s] = ids
        return ids

    def pieces(self, text: str) -> Iterable[str]:
        """The pre-tokens of a text in order; those of a long text come one by one and are never held together."""
        return self.find(text) if len(text) <= BLOCK else (m[0] for m in self.find_one_by_one(text))

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; an empty list for an empty or null one."""
        out: list[int] = []
        if text:
            known, piece = self.known.get, self.piece
            for s in self.pieces(text):
                out += known(s) or piece(s)
        return out

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        known, piece = self.known.get, self.piece
        return sum(len(known(s) or piece(s)) for s in self.pieces(text))

    def decode(self, portions: Iterable[Iterable[int]]) -> Iterator[str]:
        """Text of ids that arrive in portions; a character split between ids comes out once it is whole."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for ids in portions:
            yield machine.decode(b"".join(self.bytes_of.get(i, b"") for i in ids))
        yield machine.decode(b"", True)


def ship_tokenizer(spark: SparkSession, name: str, folder: str) -> None:
    """Give every executor, also one that joins later, the tokenizer's file, so that only the driver's machine needs the folder."""
    spark.sparkContext.addFile(os.path.join(folder, name))


@lru_cache(maxsize=2)
def byte_bpe(name: str = TOKENIZER, folder: str = TOKENIZERS) -> ByteBpe:
    """The tokenizer of a file shipped to the executors, else in `folder`, loaded once per Python worker."""
    try:
        sent = SparkFiles.get(name)
    except Exception:  # noqa: BLE001  outside of Spark there are no shipped files
        sent = ""
    return ByteBpe(sent if os.path.isfile(sent) else os.path.join(folder, name))


def encode(records: DataFrame, record: str, text: str, name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """(record, ids) of every row: the ids without special tokens, an empty list for an empty or null text.

    Strings of special tokens inside a text are ordinary text. Repeated rows stay rows of their own. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(name, folder)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # small batches keep long texts from piling up
                part = batch.slice(at, 256)
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["record", "ids"])

    ship_tokenizer(records.sparkSession, name, folder)
    kind = records.schema[record].dataType.simpleString()
    return records.select(F.col(record).alias("record"), F.col(text)).mapInArrow(run, f"record {kind}, ids array<int>").withColumnRenamed("record", record)


def count_tokens(records: DataFrame, keep: list[str], text: str, name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and n_tokens of every row; 0 for an empty or null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(name, folder)
        for batch in batches:
            n = pa.array([bpe.count(t) for t in batch.column(len(keep)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], n], [*keep, "n_tokens"])

    ship_tokenizer(records.sparkSession, name, folder)
    schema = ", ".join(f"`{c}` {records.schema[c].dataType.simpleString()}" for c in keep)
    return records.select(*keep, F.col(text).alias("__text")).mapInArrow(run, f"{schema}, n_tokens bigint")


def decode(encoded: DataFrame, record: str, ids: str = "ids", name: str = TOKENIZER, folder: str = TOKENIZERS) -> DataFrame:
    """(record, text) of every row of ids; '' for an empty or null list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(name, folder)
        for batch in batches:
            texts = ["".join(bpe.decode([x or []])) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["record", "text"])

    ship_tokenizer(encoded.sparkSession, name, folder)
    kind = encoded.schema[record].dataType.simpleString()
    return encoded.select(F.col(record).alias("record"), F.col(ids)).mapInArrow(run, f"record {kind}, text string").withColumnRenamed("record", record)
