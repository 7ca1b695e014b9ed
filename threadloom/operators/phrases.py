"""Noun phrases by rule: runs of words between function words and punctuation; identifiers and words of a dictionary always count.

A tagger says of each word whether it belongs to a phrase. The default goes by function words; overrides come after it, in this order: the
dictionary, then the shape of identifiers. Any tagger of the same form can take its place.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadloom.functions.text import EDGE_WORDS, IDENTIFIER, NOT_IDENTIFIERS, STOP_WORDS

MOST_WORDS = 6
WINDOW = 512  # words of a sentence that the tagger sees together
_TOKEN = re.compile(r"\w+(?:[._'-]\w+)*|[^\w\s]")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_IDENTIFIER = re.compile(IDENTIFIER)
_EDGE = frozenset(EDGE_WORDS)


def trim_edges(words: list[str]) -> list[str]:
    """Without determiners, pronouns and bare punctuation at both ends."""
    noise = lambda w: w.lower() in _EDGE or not any(c.isalnum() for c in w)
    while words and noise(words[0]):
        words = words[1:]
    while words and noise(words[-1]):
        words = words[:-1]
    return words


def rule_tagger(words: list[str], stop_words=STOP_WORDS) -> list[bool]:
    """Whether each word belongs to a phrase: everything but function words and bare punctuation."""
    return [any(c.isalnum() for c in w) and w.lower() not in stop_words for w in words]


def rule_chunker(text: str, stop_words=STOP_WORDS, dictionary: frozenset[str] = frozenset(), tagger: Callable[[list[str]], list[bool]] | None = None, failed: Callable[[str], None] | None = None) -> list[str]:
    """Phrases of a text, first surface of each kept: maximal runs of words that the tagger or an override puts in.

    The whole text is read, sentence by sentence, and a sentence in windows of WINDOW words that continue each other's run, so its length
    costs no memory. A sentence on which the tagger fails is passed over (`failed` is told of it), the others count.
    """
    tagger = tagger or (lambda words: rule_tagger(words, stop_words))
    out: dict[str, str] = {}

    def add(words: list[str]) -> None:
        words = trim_edges(words)
        phrase = " ".join(words)
        if 1 <= len(words) <= MOST_WORDS and len(phrase) >= 2 and any(c.isalnum() for c in phrase):
            out.setdefault(phrase.lower(), phrase)

    def fits(word: str, tagged: bool) -> bool:
        lower = word.lower()
        return tagged or lower in dictionary or len(word) >= 3 and lower not in NOT_IDENTIFIERS and bool(_IDENTIFIER.match(word))

    at = 0
    while at < len(text):
        m = _SENTENCE.search(text, at)
        stop, after = (m.start(), m.end()) if m else (len(text), len(text))
        try:
            run: list[str] = []
            tokens = (t[0] for t in _TOKEN.finditer(text, at, stop))
            while words := list(itertools.islice(tokens, WINDOW)):
                for word, tagged in zip(words, tagger(words), strict=True):
                    if fits(word, tagged):
                        run.append(word)
                    else:
                        add(run)
                        run = []
            add(run)
        except Exception:  # noqa: BLE001  one bad sentence must not cost the text
            if failed:
                failed(text[at:stop])
        at = max(after, at + 1)
    return list(out.values())


def noun_phrases(df: DataFrame, key: str, text: str, chunker: Callable[[str], list[str]] = rule_chunker) -> DataFrame:
    """(key, phrases) of every row; an empty list for null and empty texts. A chunker that fails on a whole text gives none for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                try:
                    out.append(chunker(t) if t else [])
                except Exception:  # noqa: BLE001  one bad text must not end the job
                    out.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], [key, "phrases"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(text)).mapInArrow(run, f"`{key}` {kind}, phrases array<string>")
