"""Personal information inside free text: finding it and putting typed placeholders in its place (problem 10).

Bootstrapped contextual extraction. A broad grammar proposes candidates (stretches shaped like an email, a number, an address or
a name) with an instance (what it is made of: a given and a family name, a number's digit signature, a street word) and its lexical
patterns (the words before and after). Seeds are known instances: listed given names, international phone prefixes, labelled identity
numbers, common street words. Rounds over the pattern-instance graph then let seeds vouch for patterns, patterns for instances, and
instances for further patterns; what is vouched for well enough is personal information, also where it was never listed.

Candidates come from one Arrow pass. The rounds run over distinct (instance, patterns) combinations with counts, which shrink
with the repetition of a corpus; all aggregates combine before their shuffle.

Pairs of lower-case words are too many to be candidates everywhere. The first pass takes those with a listed given name or a cue; a second
one takes every pair in a context that the rounds have made a confident pattern of names and that is not spread over ordinary pairs as
well, so that unlisted names are found there too.
"""

from __future__ import annotations

import bisect
import re
import string
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.skew import hot_keys, keyed_join
from threadloom.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")
MOST_NAMES = 1_000_000
CANDIDATES = "doc_id bigint, start int, stop int, pii_key string, shape string, inst string, mate string, seed string, pats array<string>"

#: Street words of the seed (fixed values: public vocabulary).
STREETS_EN = "street st road rd lane ln avenue ave court ct close drive dr way boulevard blvd terrace place square crescent"
STREETS_DE = "straße strasse str weg allee gasse platz ufer damm ring"
STREETS_FR = "rue avenue boulevard quai impasse chemin place allée route cours"
STREETS_ES = "calle avenida paseo plaza camino ronda carretera travesía c/ avda"
#: Parts of a building, which are no part of an address here (fixed values: public vocabulary).
_UNITS = frozenset("flat unit apt apartment suite room floor wohnung whg app appartement bât étage piso puerta planta local".split())
#: Words that label an identity number (fixed values: public vocabulary).
ID_LABELS = r"(?:ssn|social security(?: number| no\.?)?|passport(?: no\.?| number)?|ni number|insurance no\.?|nino|steuer-?id|steueridentifikationsnummer|idnr\.?|nir|insee|sécurité sociale|dni|nie|documento(?: n\.º)?|tax id|personalausweis\w*|reisepass\w*|passeport|pasaporte)"

_UP = r"A-ZÀ-ÖØ-Þ"
_LOW = r"a-zß-öø-ÿ"
_WORD = rf"[{_UP}][{_UP}{_LOW}’']+"
_GAP = r"[ \u00a0]"

_AT = rf"(?:{_GAP}?@{_GAP}?|{_GAP}?[(\[{{](?:at|AT|At)[)\]}}]{_GAP}?|{_GAP}(?:AT|at){_GAP}(?=[\w-]+(?:{_GAP}(?:DOT|dot){_GAP}|{_GAP}?[(\[](?:dot|DOT)[)\]])))"
_DOT = rf"(?:\.|{_GAP}?[(\[{{](?:dot|DOT|Dot)[)\]}}]{_GAP}?|{_GAP}(?:DOT|dot){_GAP})"
EMAIL = re.compile(rf"(?<![\w.+%-])[\w](?:[\w.+%-]*[\w])?{_AT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9-]+)*{_DOT}[A-Za-z]{{2,}}(?![\w])")
_SEP = r"[  ./‐-–-]"
NUMBER = re.compile(
    r"(?<![\w@.+/:-])(?:"
    r"[A-Z]{2}[  ]?\d{2}(?:[  ]?\d{2}){2}[  ]?[A-Z](?!\w)"  # letters, digits, letter
    r"|[A-Z]{1,3}\d{5,9}(?!\w)"
    r"|\d{7,9}[ ‐-–-]?[A-Z](?!\w)"
    rf"|\+?(?:\(\d{{1,5}}\)[  ]?)?\d+(?:(?:[  ]?\(\d{{1,4}}\)[  ]?|{_SEP}(?!\d{{4}}-\d\d-\d\d))\d+)*(?!\w)"
    r")"
)
_CAPS = rf"[{_UP}][\w-]*(?:{_GAP}[{_UP}][\w-]*){{0,3}}"
#: Number first: "12b Alder Street", "12 bis, rue des Ormes".
_NO = rf"(?<![\w.,/:-])\d{{1,5}}(?:{_GAP}?[a-zA-Z](?!\w))?(?:{_GAP}?(?i:bis|ter|quater)(?!\w))?,?{_GAP}"
ADDRESS_EN = re.compile(rf"{_NO}(?:{_WORD}{_GAP}){{1,4}}?(?P<word>(?i:{'|'.join(STREETS_EN.split())}))(?!\w)\.?")
ADDRESS_EN_NEW = re.compile(rf"{_NO}{_WORD}{_GAP}(?P<word>{_WORD})(?!\w)")
_OF = rf"(?:de{_GAP}la{_GAP}|de{_GAP}l[’']|des{_GAP}|du{_GAP}|d[’']|de{_GAP}|DE{_GAP}LA{_GAP}|DE{_GAP}L[’']|DES{_GAP}|DU{_GAP}|DE{_GAP}|D[’'])"
ADDRESS_FR = re.compile(rf"{_NO}(?:(?P<word>[a-zà-ÿ]{{3,10}}){_GAP}{_OF}?|(?P<cap>[{_UP}][\wÀ-ÿ]{{2,9}}){_GAP}{_OF}){_CAPS}")
#: Street first: "Lindenstraße 30b", "Calle del Pozo Seco, n.º 12".
ADDRESS_DE = re.compile(rf"(?<![\w.-])(?:(?:Am|An{_GAP}der|Im|Zum|Zur|Alte|Alter|Neue|Neuer|Große|Kleine){_GAP})?(?P<word>[{_UP}][\w-]+\.?){_GAP}\d{{1,4}}{_GAP}?(?:[a-z](?!\w))?(?![\w:.-]\d|\w)")
ADDRESS_ES = re.compile(
    rf"(?<![\w.-])(?P<word>[A-Za-zÀ-ÿ]{{4,10}}\.?|[Cc]/){_GAP}?(?:(?:del|de{_GAP}la|de{_GAP}los|de{_GAP}las|de|DEL|DE{_GAP}LA|DE){_GAP})?{_CAPS},?{_GAP}"
    rf"(?:[nN]\.?{_GAP}?[ºo°]\.?{_GAP}?|núm\.?{_GAP}?)?\d{{1,4}}{_GAP}?(?:[a-z](?!\w))?(?![\w:.-]\d|\w)"
)
#: A given name with its family name ahead; what stands before it is looked at by `_begins`.
NAME = re.compile(rf"(?P<a>{_WORD})(?={_GAP}(?:(?P<i>[{_UP}]\.){_GAP})?(?P<b>{_WORD}(?:-{_WORD})*)(?![\w’'-]))")
#: Lower-case names of the first pass: where the given name is listed or a cue stands before (fixed values: public vocabulary).
_CUE = re.compile(rf"\b(?:name is|name ist|appelle|me llamo|nombre es){_GAP}(?=[a-zß-öø-ÿ])")
_CUED = re.compile(rf"\b(?:name is|name ist|appelle|me llamo|nombre es){_GAP}$")
_LOWER_WORD = re.compile("[a-zß-öø-ÿ]{3,}")
#: A pair of lower-case words, the second one ahead, so that pairs overlap.
PAIR = re.compile(rf"([a-zß-öø-ÿ]{{3,}}){_GAP}(?=([a-zß-öø-ÿ]{{3,}}(?:-[a-zß-öø-ÿ]{{3,}})*)(?![\w’'-]))")
FAMILY_FIRST = re.compile(rf"(?P<b>{_WORD}(?:-{_WORD})*),(?={_GAP}(?P<a>{_WORD})(?:{_GAP}(?P<i>[{_UP}]\.))?(?![\w’'-]))")

# Where a match of the patterns above can begin or must lie: cheap searches that spare the patterns most of a text.
_MAIL_SIGNS = ("@", "at)", "at]", "at}", "AT)", "AT]", "AT}", "At)", "At]", "At}", " at ", " AT ", "\u00a0at", "\u00a0AT", "at\u00a0", "AT\u00a0")
_MAIL_AT = re.compile(rf"[@aA](?:(?<=@)|(?<=[(\[{{ \u00a0]a)t[)\]}} \u00a0]|(?<=[(\[{{ \u00a0]A)[tT][)\]}} \u00a0])")
_NUMBER_AT = re.compile(r"[A-Z\d+(](?:(?<=[A-Z])(?=[A-Z]{0,2}[ \u00a0]?\d)|(?<![A-Z])(?<![\w@.+/:-].))")
_HOUSE_AT = re.compile(rf"\d(?<![\w.,/:-].)(?=\d{{0,4}}(?:{_GAP}?[a-zA-Z](?!\w))?(?:{_GAP}?(?i:bis|ter|quater)(?!\w))?,?{_GAP}[A-Za-zÀ-ÿ])")
_STREET_AT = re.compile(rf"[{_UP}](?<![\w-].)[\w-]*\.?,?{_GAP}(?=(?:[nN]\.?{_GAP}?[ºo°]\.?{_GAP}?|núm\.?{_GAP}?)?\d)")
_CONTEXT = re.compile(r"\w+|[^\w\s]")
_WORDS = re.compile(r"\w+")
_SIGNS = re.compile(r"\w+|[^\w\s]|\s")  # leaves nothing out
_HEAD = re.compile(r"(?:\[\d\d:\d\d\]|\b(?:Human|Assistant):)$")


def _begins(text: str, at: int) -> bool:
    """Whether no word, apostrophe or hyphen runs into a place."""
    return at == 0 or not ((c := text[at - 1]).isalnum() or c in "_’'-")


def _lines(text: str, hits: re.Pattern) -> Iterator[tuple[int, int]]:
    """(start, stop) of the lines that have a hit."""
    at = 0
    while m := hits.search(text, at):
        stop = text.find("\n", m.end() - 1)
        stop = len(text) if stop < 0 else stop
        yield text.rfind("\n", 0, m.start()) + 1, stop
        at = stop


def _from(pattern: re.Pattern, starts: Iterable[int], text: str) -> Iterator[re.Match]:
    """The matches of a pattern, in order and apart, that begin at one of the places."""
    end = 0
    for at in starts:
        if at >= end and (m := pattern.match(text, at)):
            end = m.end()
            yield m


def _around(text: str, a: int, b: int) -> tuple[str, str, str, str]:
    """(the word before the last, the last word, the next sign, the one after) of a stretch on its line, in lower case.

    ^ and $ stand beyond the line's ends, ^ also behind the head of a chat turn; other signs before the stretch are passed over.
    """
    window = 64
    while True:
        low = max(0, a - window)
        before = text[low:a]
        line = before.rfind("\n") + 1
        words = _WORDS.findall(before[line:].lower())
        if line or low == 0 or len(words) > 2:
            break
        window *= 4
    head = before[line:].rstrip()
    if head[-1:] in (":", "]") and _HEAD.search(head):
        words = []
    window = 32
    while True:
        after, end, _ = text[b : b + window].partition("\n")
        signs = _CONTEXT.findall(after.lower())
        if end or b + window >= len(text) or len(signs) > 2:
            break
        window *= 4
    left, right = ["^", "^", *words][-2:], [*signs[:2], "", ""][:2]
    return left[0], left[1], right[0] or "$", right[1]


def _dashed(text: str, a: int) -> bool:
    """Whether -- stands before a place."""
    while a and text[a - 1] in " \u00a0\t":
        a -= 1
    return text.endswith("--", 0, a)


def _patterns(text: str, a: int, b: int) -> list[str]:
    """The contexts of a stretch: the word before, two words before, what follows, the word before with what follows, and a dash before."""
    before, last, then, after = _around(text, a, b)
    dash = ["5 --"] if _dashed(text, a) else []
    return [f"1 {last}", f"2 {before} {last}", f"3 {then} {after}" if after else f"3 {then}", f"4 {last} _ {then}", *dash]


def pii_key(stretch: str) -> str:
    """A stretch in lower case with letters and digits only."""
    low = stretch.lower()
    if low.isascii():
        return "".join(filter(str.isalnum, low))
    return "".join(c for c in low if c.isalpha() or unicodedata.category(c)[0] in "LN")


_SIGNATURE = str.maketrans({**{c: "9" for c in string.digits}, **{c: "A" for c in string.ascii_uppercase}, **{chr(c): "-" for c in range(0x2010, 0x2014)}, "\u00a0": " "})


def signature(s: str) -> str:
    """Digits as 9 and capitals as A; all else stays."""
    flat = s.translate(_SIGNATURE)
    return flat if flat.isascii() else re.sub(r"\d", "9", flat)


_LABELLED = re.compile(ID_LABELS + r"\s*[:=.º°]{0,2}\s*$", re.I)
_EN, _DE, _FR, _ES = (tuple(x.split()) for x in (STREETS_EN, STREETS_DE, STREETS_FR, STREETS_ES))


def _addresses(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, stop, instance, seed) of the address candidates; the instance is the street word or a compound's ending."""
    starts = [m.start() for m in _HOUSE_AT.finditer(text)]
    if starts:
        known = set()
        for m in _from(ADDRESS_EN, starts, text):
            known.add(m.start())
            yield m.start(), m.end(), f"en {m['word'].lower()}", "address"
        for m in _from(ADDRESS_EN_NEW, starts, text):
            if m.start() not in known:
                yield m.start(), m.end(), f"en {m['word'].lower()}", ""
        for m in _from(ADDRESS_FR, starts, text):
            word = (m["word"] or m["cap"]).lower()
            yield m.start(), m.end(), f"fr {word}", "address" if word in _FR else ""
    for a, b in _lines(text, _STREET_AT):
        for m in ADDRESS_ES.finditer(text, a, b):
            word = m["word"].lower().rstrip(".")
            yield m.start(), m.end(), f"es {word}", "address" if word in _ES else ""
        for m in ADDRESS_DE.finditer(text, a, b):
            word = m["word"].lower().rstrip(".")
            tail = next((s for s in _DE if word.endswith(s)), None)
            if word not in _UNITS:
                yield m.start(), m.end(), f"de {tail or word[-5:]}", "address" if tail else ""


def _cued(text: str, listed: frozenset[str]) -> Iterator[re.Match]:
    """The pairs of lower-case words with a listed given name or behind a cue."""
    cues = {m.end() for m in _CUE.finditer(text)}
    if cues or not listed.isdisjoint(_LOWER_WORD.findall(text)):
        for m in PAIR.finditer(text):
            if (m.start() in cues or m[1] in listed) and _begins(text, m.start()):
                yield m


def candidates_of(text: str, listed: frozenset[str]) -> Iterator[tuple[int, int, str, str, str, str, list[str]]]:
    """(start, stop, shape, instance, mate, seed, patterns) of every candidate of a text."""
    if any(sign in text for sign in _MAIL_SIGNS):
        for a, b in _lines(text, _MAIL_AT):
            for m in EMAIL.finditer(text, a, b):
                yield m.start(), m.end(), "email", "email", "", "email", []
    for m in _from(NUMBER, (m.start() for m in _NUMBER_AT.finditer(text)), text):
        a, b = m.span()
        s = m[0]
        digits = sum(map(str.isdigit, s)) if b - a >= 5 else 0
        if digits < 5:
            continue
        seed = ""
        if _LABELLED.search(text[max(0, a - 45) : a]):
            seed = "id_number"
        elif re.match(r"\+\d", s) and digits >= 8 or re.match(r"00[1-9]", s) and re.search(_SEP, s) and digits >= 11:
            seed = "phone"
        yield a, b, "number", signature(s), "", seed, _patterns(text, a, b)
    for a, b, inst, seed in _addresses(text):
        yield a, b, "address", inst, "", seed, _patterns(text, a, b)
    straight = set()
    for m in NAME.finditer(text):
        if _begins(text, m.start()):
            given = m["a"].lower()
            straight.add(m.start())
            yield m.start(), m.end("b"), "name", given, m["b"].lower(), "name" if given in listed else "", _patterns(text, m.start(), m.end("b"))
    for m in _cued(text, listed):
        yield m.start(), m.end(2), "lower", m[1], m[2], "", _patterns(text, m.start(), m.end(2))
    for m in FAMILY_FIRST.finditer(text):
        if _begins(text, m.start()):
            given = m["a"].lower()
            end = m.end("i") if m["i"] else m.end("a")
            # A given name that has its family name behind it says nothing about the word before it.
            seed = "name" if given in listed and m.start("a") not in straight else ""
            yield m.start(), end, "name", given, m["b"].lower(), seed, _patterns(text, m.start(), end)


def _slot(pattern: str) -> int:
    return zlib.crc32(pattern.encode()) % SLOTS


def _chain(text: str, at: int) -> re.Match | None:
    """The pair of lower-case words that begins at a place."""
    return PAIR.match(text, at) if _begins(text, at) else None


class Pairs:
    """The pairs of lower-case words of many texts, with their contexts.

    The texts are cut into all their words and signs at once, as numbers of a common vocabulary; pairs and contexts are then found on
    arrays, and each distinct context is looked up once. Only pairs with a hyphen or an apostrophe behind them, or behind the head of a chat turn or a
    dash, are looked at one by one.
    """

    def __init__(self, texts: list[str], contexts: np.ndarray) -> None:
        self.contexts = contexts
        self.text = "\n".join(texts)
        self.bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        coded = pa.array(_SIGNS.findall(self.text), pa.string()).dictionary_encode()
        self.ids = ids = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary.to_pylist()
        self.low = [w.lower() for w in words]
        n = len(ids)
        of = lambda f: np.array([f(w) for w in words], bool)[ids] if n else np.zeros(0, bool)
        size = np.array([len(w) for w in words], np.int64)[ids] if n else np.zeros(0, np.int64)
        self.starts = np.append(np.cumsum(size) - size, len(self.text))
        plain, gap, joint = of(lambda w: _LOWER_WORD.fullmatch(w) is not None), of(lambda w: w in " \u00a0"), of(lambda w: w in "’'-")
        at = np.flatnonzero(plain[:-2] & gap[1:-1] & plain[2:]) if n > 2 else np.zeros(0, np.int64)
        at = at[~np.where(at > 0, joint[at - 1], False)]
        odd = np.where(at + 3 < n, joint[np.minimum(at + 3, n - 1)], False) if n else np.zeros(0, bool)
        self.at, line, space = at[~odd], np.cumsum(of(lambda w: w == "\n")), of(str.isspace)
        self.odd = [m for i in at[odd] if (m := self._one(i))]
        at = self.at
        word, signs = np.flatnonzero(of(lambda w: w[0].isalnum() or w[0] == "_")), np.flatnonzero(~space)

        def near(places: np.ndarray, rank: np.ndarray) -> np.ndarray:
            """The words or signs at a rank if they are on the pair's line, else -1."""
            token = places[np.clip(rank, 0, len(places) - 1)]
            return np.where((rank >= 0) & (rank < len(places)) & (line[token] == line[at]), ids[token], -1)

        if len(at):
            rank, behind = np.searchsorted(word, at), np.searchsorted(signs, at + 2) + 1
            self.last, self.before = near(word, rank - 1), near(word, rank - 2)
            self.then, self.after = near(signs, behind), near(signs, behind + 1)
            ahead = np.searchsorted(signs, at) - 1
            before = signs[np.maximum(ahead, 0)]
            special = (ahead >= 0) & (line[before] == line[at]) & of(lambda w: w in ":]")[before]
            if "--" in self.text:
                special |= (ahead >= 0) & of(lambda w: w == "-")[before]
            self.odd += [m for i in at[special] if (m := self._one(i))]
            self.plain = ~special

    def _one(self, i: int) -> re.Match | None:
        """The pair that begins at a word or sign."""
        start = int(self.starts[i])
        return PAIR.match(self.text, start) if _begins(self.text, start) else None

    def seen(self) -> Iterator[tuple[str, str, int]]:
        """(which of the two, word, how often) over all pairs."""
        for place, shift, group in (("inst", 0, 1), ("mate", 2, 2)):
            seen = Counter(m[group] for m in self.odd)
            if len(self.at):
                for i, n in zip(*np.unique(self.ids[self.at[self.plain] + shift], return_counts=True)):
                    seen[self.low[i]] += int(n)
            yield from ((place, word, n) for word, n in seen.items())

    def _slots(self) -> Iterator[np.ndarray]:
        """For each kind of pattern the slot of every plain pair's one; every distinct pattern is made once."""
        word = lambda i, none: self.low[i] if i >= 0 else none
        makes = (
            (lambda x, _: f"1 {word(x, '^')}", self.last, None), (lambda y, x: f"2 {word(y, '^')} {word(x, '^')}", self.before, self.last),
            (lambda r, q: f"3 {word(r, '$')} {word(q, '')}".rstrip(), self.then, self.after), (lambda x, r: f"4 {word(x, '^')} _ {word(r, '$')}", self.last, self.then),
        )
        for make, x, y in makes:
            x, y = x[self.plain], np.zeros(0, np.int64) if y is None else y[self.plain]
            _, first, back = np.unique(x * (len(self.low) + 1) + y if len(y) else x, return_index=True, return_inverse=True)
            yield np.array([_slot(make(int(x[i]), int(y[i]) if len(y) else 0)) for i in first], np.int64)[back.ravel()]

    def surrounded(self) -> Iterator[tuple[int, int]]:
        """(slot, how many pairs it surrounds) of the contexts."""
        count: Counter = Counter(s for m in self.odd for s in map(_slot, _patterns(self.text, m.start(), m.end(2))) if self.contexts[s])
        if len(self.at):
            for slots in self._slots():
                for s, n in zip(*np.unique(slots[self.contexts[slots]], return_counts=True)):
                    count[int(s)] += int(n)
        return iter(count.items())

    def _hits(self) -> Iterator[tuple[int, int, str, str]]:
        """(start, stop, first word, second word) of the pairs in one of the contexts."""
        if len(self.at):
            for i in self.at[self.plain][np.any([self.contexts[slots] for slots in self._slots()], 0)]:
                yield int(self.starts[i]), int(self.starts[i + 3]), self.low[self.ids[i]], self.low[self.ids[i + 2]]
        for m in self.odd:
            if any(self.contexts[_slot(p)] for p in _patterns(self.text, m.start(), m.end(2))):
                yield m.start(), m.end(2), m[1], m[2]

    def rows(self, listed: frozenset[str]) -> Iterator[tuple[int, int, int, str, str, str, str, str, list[str]]]:
        """(which text, start, stop, key, then as candidates_of) of the pairs in a context that were no candidates of the first pass."""
        for a, b, inst, mate in sorted(self._hits()):
            which = int(np.searchsorted(self.bounds, a, "right")) - 1
            if inst not in listed and not _CUED.search(self.text[self.text.rfind("\n", 0, a) + 1 : a]):
                off = int(self.bounds[which])
                yield which, a - off, b - off, pii_key(self.text[a:b]), "learned", inst, mate, "", _patterns(self.text, a, b)


def _portions(column: list[str]) -> Iterator[slice]:
    """Slices of texts of about CHARS characters together, at least one text each."""
    at = size = 0
    for i, text in enumerate(column):
        if size and size + len(text) > CHARS:
            yield slice(at, i)
            at, size = i, 0
        size += len(text)
    if at < len(column):
        yield slice(at, len(column))


def _columns(rows: list, types: list) -> list[pa.Array]:
    return [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[] for _ in types], types)]


_NAMES = ["doc_id", "start", "stop", "pii_key", "shape", "inst", "mate", "seed", "pats"]
_TYPES = [pa.int64(), pa.int32(), pa.int32(), *[pa.string()] * 5, pa.list_(pa.string())]


def _texts(documents: DataFrame, record: str, text: str) -> DataFrame:
    return documents.select(F.col(record).cast("bigint").alias("doc_id"), F.col(text)).filter(F.col(text) != "")


def candidates(documents: DataFrame, listed: frozenset[str], record: str = "doc_id", text: str = "text", contexts: np.ndarray | None = None) -> DataFrame:
    """All candidates of all documents; null and empty texts have none. With `contexts`, those of the second pass (Pairs.rows)."""
    held = documents.sparkSession.sparkContext.broadcast((listed, contexts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, contexts = held.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in _portions(texts):
                if contexts is None:
                    rows = [(d, a, b, pii_key(t[a:b]), *c) for d, t in zip(ids[part], texts[part]) for a, b, *c in candidates_of(t, listed)]
                else:
                    rows = [(ids[part][which], *c) for which, *c in Pairs(texts[part], contexts).rows(listed)]
                yield pa.RecordBatch.from_arrays(_columns(rows, _TYPES), _NAMES)

    return _texts(documents, record, text).mapInArrow(run, CANDIDATES)


def pair_counts(documents: DataFrame, contexts: np.ndarray, record: str = "doc_id", text: str = "text") -> DataFrame:
    """(what, word, slot, n): how often a word begins (inst) or ends (mate) pairs of lower-case words, and how many pairs a context (slot) surrounds."""
    held = documents.sparkSession.sparkContext.broadcast(contexts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _portions(texts):
                pairs = Pairs(texts[part], held.value)
                rows = [(place, word, None, n) for place, word, n in pairs.seen()] + [("slot", None, s, n) for s, n in pairs.surrounded()]
                yield pa.RecordBatch.from_arrays(_columns(rows, [pa.string(), pa.string(), pa.int32(), pa.int64()]), ["what", "word", "slot", "n"])

    counts = _texts(documents, record, text).mapInArrow(run, "what string, word string, slot int, n bigint")
    return counts.groupBy("what", "word", "slot").agg(F.sum("n").alias("n"))


#: Which kinds a candidate of a shape may be, and the confidence from which a pattern vouches.
SHAPE_KINDS = {"lower": ["name"], "number": ["phone", "id_number"], "address": ["address"], "name": ["name"]}
VOUCHES = {"phone": 0.1, "id_number": 0.1, "address": 0.3, "name": 0.4}
SMOOTH = 0.5
ROUNDS = 6
STILL = 0.01
ALMOST = 0.3
#: Characters of the texts that the second pass looks at together.
CHARS = 1 << 21
RARE = 0.25
#: Places of the table of learned contexts by hash: its size is bounded, and a collision only proposes a pair that the exact patterns then leave alone.
SLOTS = 1 << 22
#: The belief from which a candidate is personal information.
ACCEPT = {"phone": 0.5, "id_number": 0.5, "address": 0.7, "name": 0.45}


#: Two independent hashes of what makes a combination, its key; one alone would repeat from some billion combinations on.
KEY = ["e", "f"]


def _keyed(df: DataFrame) -> DataFrame:
    made_of = ["shape", "inst", "mate", "seed", "pats"]
    return df.withColumns({"e": F.xxhash64(*made_of), "f": F.xxhash64(F.lit("second"), *made_of)})


def combinations(found: DataFrame) -> DataFrame:
    """(shape, inst, mate, seed, pats, n, e, f): the distinct combinations of candidates that need evidence (emails need none), with their number."""
    return _keyed(found.filter("shape <> 'email'").groupBy("shape", "inst", "mate", "seed", "pats").agg(F.count(F.lit(1)).alias("n")))


def _count(df: DataFrame, keys: list[str]) -> DataFrame:
    return hot_keys(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys)


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, still: float = STILL) -> DataFrame:
    """`edges` (combinations) by kind, with belief, by_pattern, by_inst and by_mate: the confidences after the rounds.

    A pattern's confidence is the mean belief in what it surrounds, an instance's the mean of the best confident pattern of each
    occurrence; SMOOTH occurrences without belief are added to both, so that rare ones count less. Seeds are believed throughout. The rounds
    end when no belief moves by more than `still`. Patterns, instances and family names that many combinations share are found once
    and stay in place in every round's joins (`keyed_join`).
    """
    kinds = F.create_map(*[x for k, v in SHAPE_KINDS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    edges = cut(edges.select(F.explode(kinds[F.col("shape")]).alias("kind"), "*"))
    exploded = lambda df: df.select("*", F.explode("pats").alias("pat")).filter((F.col("kind") == "name") | ~F.col("pat").startswith("3"))
    family = F.when(F.col("mate") != "", F.col("mate"))
    hot = {c: _count(exploded(edges), ["kind", c]) if c == "pat" else _count(edges.withColumn("mate", family), ["kind", c]) for c in ("pat", "inst", "mate")}
    known = edges.withColumn("belief", (F.col("seed") == F.col("kind")).cast("double"))
    vouch = F.create_map(*[x for k, v in VOUCHES.items() for x in (F.lit(k), F.lit(v))])
    for _ in range(rounds):
        links = exploded(known.select("kind", *KEY, "n", "belief", "pats")).drop("pats")
        patterns = links.groupBy("kind", "pat").agg((F.sum(F.col("belief") * F.col("n")) / (F.sum("n") + SMOOTH)).alias("conf"))
        patterns = patterns.filter(F.col("conf") >= vouch[F.col("kind")])
        best = keyed_join(links.select("kind", "pat", *KEY), patterns, ["kind", "pat"], hot=hot["pat"]).groupBy("kind", *KEY).agg(F.max("conf").alias("by_pattern"))
        was = known.select(*edges.columns, F.col("belief").alias("was"))
        scored = cut(was.join(best, ["kind", *KEY], "left").fillna(0.0, ["by_pattern"]).withColumn("mate", family))
        seeded = F.when(F.col("seed") == F.col("kind"), 1.0).when(F.col("seed") != "", 0.0).otherwise(F.col("by_pattern"))

        def support(c: str, scored: DataFrame = scored, seeded: Column = seeded) -> DataFrame:
            return scored.filter(F.col(c).isNotNull()).groupBy("kind", c).agg(F.sum(seeded * F.col("n")).alias("s"), F.sum("n").alias("t"))

        inst = support("inst").select("kind", "inst", (F.col("s") / (F.col("t") + SMOOTH)).alias("by_inst"), ((F.col("s") + 1) / (F.col("t") + 2)).alias("may_inst"), (F.col("t") - F.col("s")).alias("idle"))
        # A word that begins unsupported candidates more often than it ends supported ones is an ordinary word, no family name.
        words = inst.filter("kind = 'name'").select("kind", F.col("inst").alias("mate"), "idle")
        mate = support("mate").join(words, ["kind", "mate"], "left").select("kind", "mate", (F.col("s") / (F.col("t") + SMOOTH)).alias("by_mate"), (F.coalesce("idle", F.lit(0.0)) > F.col("s")).alias("ordinary"))
        joined = keyed_join(keyed_join(scored, inst.drop("idle"), ["kind", "inst"], "left", hot=hot["inst"]), mate, ["kind", "mate"], "left", hot=hot["mate"])
        joined = joined.fillna(0.0, ["by_inst", "by_mate", "may_inst"]).fillna({"ordinary": False, "mate": ""})
        # A family name vouches for a given name unless that is a word seen often without any support.
        kin = F.when(F.col("may_inst") >= RARE, F.col("by_mate")).otherwise(0.0)
        belief = F.when(F.col("kind") == "name", F.greatest("by_inst", F.least("by_pattern", "by_mate"), kin)).otherwise(F.col("by_inst"))
        belief = F.when(F.col("shape") == "lower", F.least(belief, F.greatest("by_mate", "by_pattern"))).otherwise(belief)
        belief = F.when(F.col("seed") == F.col("kind"), 1.0).when(F.col("seed") != "", 0.0).otherwise(belief)
        known = cut(joined.withColumn("belief", F.when((F.col("kind") == "name") & F.col("ordinary"), 0.0).otherwise(belief)).drop("may_inst", "ordinary"))
        moved = known.agg(F.max(F.abs(F.col("belief") - F.col("was"))).alias("m")).first().m
        if moved is None or moved <= still:
            break
    return known


def learned_patterns(known: DataFrame) -> DataFrame:
    """(pat, s, t, slot): the patterns that surround names confidently, with the belief in and the number of what they surround."""
    links = known.filter("kind = 'name'").select("n", "belief", F.explode("pats").alias("pat"))
    sure = links.groupBy("pat").agg(F.sum(F.col("belief") * F.col("n")).alias("s"), F.sum("n").alias("t")).filter(F.col("s") / (F.col("t") + SMOOTH) >= VOUCHES["name"])
    return sure.withColumn("slot", (F.crc32(F.encode("pat", "utf-8")) % SLOTS).cast("int"))


def slot_table(patterns: DataFrame) -> np.ndarray:
    """Whether each of SLOTS places is the hash of a pattern."""
    contexts = np.zeros(SLOTS, bool)
    contexts[patterns.select("slot").distinct().toArrow()["slot"].to_numpy()] = True
    return contexts


def telling(patterns: DataFrame, surrounded: DataFrame) -> DataFrame:
    """The patterns that tell names also among pairs of lower-case words.

    What ends a sentence surrounds many names, but far more other pairs. A pattern stays while it could still be confident if ALMOST of
    the pairs around it were names.
    """
    met = patterns.join(surrounded.filter("what = 'slot'").select("slot", F.col("n").alias("pairs")), "slot", "left").fillna(0, ["pairs"])
    return met.filter((F.col("s") + ALMOST * F.col("pairs")) / (F.col("t") + F.col("pairs") + SMOOTH) >= VOUCHES["name"])


def extend(known: DataFrame, edges: DataFrame, seen: DataFrame, rounds: int, still: float = STILL) -> DataFrame:
    """(kind, e, f, belief, by_mate) of the combinations of the second pass, from the beliefs of the first.

    A pattern's confidence counts what it surrounds in both passes. A word is supported by the best confident pattern of its
    occurrences, among all the pairs it begins or ends anywhere in the texts (`seen`), so that ordinary words have no support. A name is
    believed as far as both its words are supported; its family name may be known from the first pass.
    """
    names = known.filter("kind = 'name'")
    hot_words = {c: _count(edges, [c]) for c in ("inst", "mate")}
    hot_pats = _count(edges.select(F.explode("pats").alias("pat")), ["pat"])
    of = lambda c: seen.filter(F.col("what") == c).select(F.col("word").alias(c), F.col("n").alias(f"{c}_seen"))
    family = names.groupBy("mate").agg(F.max("by_mate").alias("family"))
    edges = keyed_join(keyed_join(edges, of("inst"), ["inst"], "left", hot=hot_words["inst"]), of("mate").join(family, "mate", "left"), ["mate"], "left", hot=hot_words["mate"])
    edges = cut(edges.fillna(0.0, ["family"]).fillna(0, ["inst_seen", "mate_seen"]))
    wanted = edges.select(F.explode("pats").alias("pat")).distinct()
    before = names.select("n", "belief", F.explode("pats").alias("pat"))
    # one row a pattern on either side: the sums of the first pass combine before they meet the patterns wanted
    before = cut(before.groupBy("pat").agg(F.sum(F.col("belief") * F.col("n")).alias("s"), F.sum("n").alias("t")).join(wanted, "pat", "left_semi"))
    scored = edges.withColumn("belief", F.lit(0.0))
    for _ in range(rounds):
        links = scored.select(*KEY, "n", "belief", F.explode("pats").alias("pat"))
        now = links.groupBy("pat").agg(F.sum(F.col("belief") * F.col("n")).alias("s"), F.sum("n").alias("t"))
        sure = now.unionByName(before).groupBy("pat").agg((F.sum("s") / (F.sum("t") + SMOOTH)).alias("conf")).filter(F.col("conf") >= VOUCHES["name"])
        best = keyed_join(links.select("pat", *KEY), sure, ["pat"], hot=hot_pats).groupBy(*KEY).agg(F.max("conf").alias("by_pattern"))
        was = scored.select(*edges.columns, F.col("belief").alias("was"))
        rated = cut(was.join(best, KEY, "left").fillna(0.0, ["by_pattern"]))

        def support(word: str, rated: DataFrame = rated) -> DataFrame:
            return rated.groupBy(word).agg((F.sum(F.col("by_pattern") * F.col("n")) / (F.greatest(F.max(f"{word}_seen"), F.sum("n")) + SMOOTH)).alias(f"by_{word}"))

        both = keyed_join(keyed_join(rated, support("inst"), ["inst"], hot=hot_words["inst"]), support("mate"), ["mate"], hot=hot_words["mate"])
        both = both.withColumn("by_mate", F.greatest("by_mate", "family"))
        scored = cut(both.withColumn("belief", F.least("by_inst", "by_mate")))
        moved = scored.agg(F.max(F.abs(F.col("belief") - F.col("was"))).alias("m")).first().m
        if moved is None or moved <= still:
            break
    return scored.select(F.lit("name").alias("kind"), *KEY, "belief", "by_mate")


def _resolved(spans: list[dict]) -> list[dict]:
    """Spans without overlap: emails first, then by belief, the mate's confidence and length; the earlier one at a tie."""
    order = sorted(spans, key=lambda s: (s["kind"] != "email", -s["belief"] - s["by_mate"], s["start"] - s["stop"], s["start"]))
    taken: list[tuple[int, int]] = []  # disjoint, so sorted by start and by stop alike
    kept = []
    for s in order:
        at = bisect.bisect_left(taken, (s["start"], s["stop"]))
        if (at == 0 or taken[at - 1][1] <= s["start"]) and (at == len(taken) or taken[at][0] >= s["stop"]):
            taken.insert(at, (s["start"], s["stop"]))
            kept.append(s)
    return sorted(kept, key=lambda s: s["start"])


def listed_names(given_name: DataFrame) -> frozenset[str]:
    """The seed names in lower case, a list of at most MOST_NAMES; more are an error."""
    rows = given_name.select("name").filter("name is not null").limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError("too many seed names")
    return frozenset(r.name.strip().lower() for r in rows)


SPAN = "array<struct<start:int,stop:int,kind:string,pii_key:string>>"


def find(documents: DataFrame, given_name: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, spans) of the documents with personal information: start, stop, kind and pii_key of each stretch, in order, without overlap.

    Null, empty and blank texts have none. Repeated texts are found alike. Only the text and its contexts count; lang and source are not read.
    Evidence comes from all documents: a name nobody listed is found where patterns or a known family name vouch for it.
    """
    listed = listed_names(given_name)
    found = cut(_keyed(candidates(documents, listed)))
    first = cut(combinations(found))
    known = bootstrap(first, rounds)
    patterns = cut(learned_patterns(known))
    seen = cut(pair_counts(documents, slot_table(patterns)))
    more = cut(_keyed(candidates(documents, listed, contexts=slot_table(telling(patterns, seen)))))
    second = cut(combinations(more))
    least = F.create_map(*[x for k, v in ACCEPT.items() for x in (F.lit(k), F.lit(v))])
    beliefs = ["kind", *KEY, "belief", "by_mate"]
    good = known.select(beliefs).unionByName(extend(known, second, seen, rounds).select(beliefs))
    good = good.filter(F.col("belief") >= least[F.col("kind")])
    best = good.groupBy(*KEY).agg(F.max(F.struct("belief", "kind", "by_mate")).alias("b"))
    place = ["doc_id", "start", "stop", "pii_key"]
    # a text that was copied often makes hot combinations; their numbers are known
    hot = hot_keys(first.select(*KEY, "n").unionByName(second.select(*KEY, "n")), KEY)
    spans = keyed_join(found.filter("shape <> 'email'").select(*place, *KEY).unionByName(more.select(*place, *KEY)), best, KEY, hot=hot)
    spans = spans.select("doc_id", F.struct("start", "stop", "b.kind", "pii_key", "b.belief", "b.by_mate").alias("s"))
    mails = found.filter("shape = 'email'").select("doc_id", F.struct("start", "stop", F.lit("email").alias("kind"), "pii_key", F.lit(1.0).alias("belief"), F.lit(0.0).alias("by_mate")).alias("s"))
    spans = spans.unionAll(mails)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("pii_key", pa.string())]))
        for batch in batches:
            kept = [[{k: s[k] for k in ("start", "stop", "kind", "pii_key")} for s in _resolved(x)] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, kind)], ["doc_id", "spans"])

    return spans.groupBy("doc_id").agg(F.collect_list("s").alias("s")).mapInArrow(run, f"doc_id bigint, spans {SPAN}")


def found_rows(spans: DataFrame) -> DataFrame:
    """(doc_id, kind, pii_key), distinct."""
    return spans.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.kind", "s.pii_key").distinct()


def redact(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc_id, text) of every document with [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [NAME] in place of each stretch; the rest is unchanged, null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, cuts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                if text is not None and cuts:
                    parts, at = [], 0
                    for s in cuts:
                        parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
                        at = s["stop"]
                    text = "".join([*parts, text[at:]])
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(spans, "doc_id", "left")
    return rows.select("doc_id", "text", "spans").mapInArrow(run, "doc_id bigint, text string")
