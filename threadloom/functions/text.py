"""Text normalisation and classification as Column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token of the analyzed text, shared by indexing and queries.
TOKEN = r"[\p{L}\p{N}_]+"

# They decide which lines count as code.
CODE_WORDS = (
    r"\b(public|private|protected|static|void|class|interface|extends|implements|"
    r"import|package|return|new|throws|catch|finally|def|elif|lambda|self|"
    r"SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|GROUP BY|ORDER BY|"
    r"function|const|let|var|=>|console\.log|"
    r"#!/bin/|echo \$|sudo |chmod |grep |awk |sed )\b"
)
CODE_SYMBOLS = r"{}();<>[]=&|%$#@"
CODE_SYMBOL_RATIO = 0.18
CODE_LINE_SCORE = 2.0

# Shapes of identifiers, and dotted prose that is none.
IDENTIFIER = r"^(?=\S*[A-Za-z])(?:[a-z]+(?:[A-Z][A-Za-z0-9]*)+|[A-Z][a-z0-9]*(?:[A-Z][A-Za-z0-9]*)+|\w+(?:_\w+)+|\w+(?:\.\w+)+|[A-Za-z]+\d+[A-Za-z0-9]*)$"
NOT_IDENTIFIERS = ["e.g", "i.e", "etc", "vs", "a.k.a"]

# Words trimmed from the edges of phrases.
EDGE_WORDS = (
    "a an the this that these those my your his her its our their i you he she it we they some any all each every "
    "another other such same no none both either neither much many more most few several"
).split()

#: Default stop words of keyword selection, a parameter everywhere: common English function words.
STOP_WORDS = frozenset(
    (
        "a about above after again all also am an and any are as at be because been before being below between both but by can could "
        "did do does doing down during each few for from further had has have having he her here hers him his how i if in into is it its "
        "just let like may me might more most must my no nor not now of off on once only or other our out over own same she should so "
        "some such than that the their them then there these they this those through to too under until up use used using very was we "
        "were what when where which while who why will with would yes yet you your"
    ).split()
)


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_words(c: Column | str) -> Column:
    """Lower case with everything but a-z and 0-9 deleted; accented letters vanish. Null stays null."""
    return F.regexp_replace(F.lower(_c(c)), "[^a-z0-9]", "")


def normalize_phrase(c: Column | str) -> Column:
    """Words normalised one by one, empty ones dropped, joined by one space. Null stays null."""
    words = F.transform(F.split(F.trim(_c(c)), r"\s+"), normalize_words)
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def normalize_content(c: Column | str) -> Column:
    """Trimmed, with each run of white space as one space; null as ''."""
    return F.coalesce(F.regexp_replace(F.regexp_replace(_c(c), r"^[\x00-\x20]+|[\x00-\x20]+$", ""), r"\s+", " "), F.lit(""))


def code_line_score(line: Column | str) -> Column:
    """How much a line looks like code: the sum of six signals; blank lines score 0."""
    line = _c(line)
    trimmed = F.trim(F.regexp_replace(line, r"^[\x00-\x20]+|[\x00-\x20]+$", ""))
    symbols = F.length(trimmed) - F.length(F.translate(trimmed, CODE_SYMBOLS, ""))
    lead = F.length(line) - F.length(F.regexp_replace(line, r"^\s+", ""))
    named = F.filter(F.split(trimmed, r"\s+"), lambda t: t.rlike(r"^([a-z]+[A-Z][a-zA-Z0-9]*|[a-z0-9_]+_[a-z0-9_]+)$"))
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    score = (
        add(trimmed.rlike(CODE_WORDS), 2.0)
        + add(trimmed.rlike(r"[;{}]$"), 1.5)
        + add(F.try_divide(symbols, F.length(trimmed)) >= CODE_SYMBOL_RATIO, 1.5)
        + add((lead >= 4) | line.startswith("\t"), 1.0)
        + add(trimmed.rlike(r'^.*"[A-Za-z0-9_]+"\s*:\s*.*$'), 1.5)
        + add(F.size(named) >= 2, 1.0)
    )
    return F.when(trimmed == "", 0.0).otherwise(score)


def is_code_line(line: Column | str) -> Column:
    return code_line_score(line) >= CODE_LINE_SCORE


def strip_code(c: Column | str) -> Column:
    """Fenced blocks and runs of code-like lines as one space, inline code as the word code, runs of blanks as one."""
    plain = F.regexp_replace(F.regexp_replace(_c(c), r"(?s)```.*?```", " "), "`[^`]*`", " code ")
    # a code line becomes a mark of its own, so a run of them is a run of marks; U+FDD0 is no character of any text
    joined = F.array_join(F.transform(F.split(plain, "\n", -1), lambda x: F.when(is_code_line(x), F.lit("\ufdd0")).otherwise(F.concat(x, F.lit("\n")))), "")
    collapsed = F.regexp_replace(joined, "\ufdd0+", " ")
    return F.regexp_replace(F.regexp_replace(collapsed, r"[ \t]{2,}", " "), r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def normalize_markdown(c: Column | str) -> Column:
    """Markdown marks removed and lines joined into sentences; a line without . ! ? : at its end gets a full stop."""
    plain = _c(c)
    for pattern in (r"\*+", r"(?m)^#+\s*", r"(?m)^\s*[-*+]\s*", r"(?m)^\s*\d+\.\s*"):
        plain = F.regexp_replace(plain, pattern, "")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, r"^[\x00-\x20]+|[\x00-\x20]+$", "")), lambda x: x != "")
    joined = F.aggregate(lines, F.lit(""), lambda acc, x: F.when(acc == "", x).when(acc.rlike("[.!?:]$"), F.concat(acc, F.lit(" "), x)).otherwise(F.concat(acc, F.lit(". "), x)))
    return F.trim(F.regexp_replace(joined, r"\s+", " "))


def semantic_noise(c: Column | str) -> Column:
    """Fewer than three ASCII letters and digits; null is noise."""
    return F.coalesce(F.length(F.regexp_replace(_c(c), "[^a-zA-Z0-9]", "")) < 3, F.lit(True))


def tokens(c: Column | str) -> Column:
    """All tokens of the lower-cased text in order; null for null."""
    return F.regexp_extract_all(F.lower(_c(c)), F.lit(TOKEN), F.lit(0))


def counted(words: Column | str) -> Column:
    """array<struct<term, tf bigint>> of an array of words: each distinct one with how often it occurs.

    The words are sorted and the runs of equal ones measured, inside the row, so counting the terms of a record shuffles nothing.
    """
    ordered = F.sort_array(_c(words))
    begins = lambda s: F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x != F.get(s, i - 1)), i)), lambda i: i.isNotNull())
    run = lambda s, b: F.transform(b, lambda p, k: F.struct(F.get(s, p).alias("term"), (F.coalesce(F.get(b, k + 1), F.size(s)) - p).cast("bigint").alias("tf")))
    # each step takes the one before as a lambda's variable, so that it is made once a row and not once an element
    with_begins = F.transform(F.transform(F.array(ordered), lambda s: F.struct(s.alias("s"), begins(s).alias("b"))), lambda v: run(v.getField("s"), v.getField("b")))
    return F.get(with_begins, F.lit(0))


def query_tokens(c: Column | str) -> Column:
    """Distinct tokens in order of their first occurrence."""
    return F.array_distinct(tokens(c))


def valid_keyword(term: Column | str, stop_words=STOP_WORDS) -> Column:
    """3 to 50 characters, no stop word, at least one letter, at most two characters beside letters, digits, - and _."""
    term = _c(term)
    odd = F.length(F.regexp_replace(term, r"[\p{L}\p{N}_-]", ""))
    return F.length(term).between(3, 50) & ~term.isin(*sorted(stop_words)) & term.rlike(r"\p{L}") & (odd <= 2)


def is_identifier(token: Column | str) -> Column:
    """Whether a token of at least three characters has the shape of an identifier."""
    token = _c(token)
    return (F.length(token) >= 3) & ~F.lower(token).isin(*NOT_IDENTIFIERS) & token.rlike(IDENTIFIER)


def trim_phrase(c: Column | str) -> Column:
    """Determiners, pronouns and bare punctuation removed from both ends; null where more than six words, under two characters or no letter or digit remain."""
    words = F.split(F.trim(_c(c)), r"\s+")
    noise = lambda w: F.lower(w).isin(*EDGE_WORDS) | ~w.rlike(r"[\p{L}\p{N}]")
    solid = F.filter(F.transform(words, lambda w, i: F.when(~noise(w), i)), lambda i: i.isNotNull())
    kept = F.when(F.size(solid) > 0, F.slice(words, F.array_min(solid) + 1, F.array_max(solid) - F.array_min(solid) + 1))
    phrase = F.array_join(kept, " ")
    return F.when((F.size(kept) <= 6) & (F.length(phrase) >= 2), phrase)


def conversation_url(uuid: Column | str) -> Column:
    return F.concat(F.lit("https://claude.ai/chat/"), _c(uuid))


def canonical_email(c: Column | str) -> Column:
    return F.lower(F.trim(_c(c)))


def pair_key(a: Column | str, b: Column | str) -> Column:
    """The unordered pair as 'a|b' with a < b."""
    return F.concat_ws("|", F.least(_c(a), _c(b)), F.greatest(_c(a), _c(b)))


def parse_pair(c: Column | str) -> Column:
    """struct<a, b> of a pair key of two numbers; nulls where it is malformed."""
    parts = F.split(_c(c), r"\|", 2)
    return F.struct(F.get(parts, F.lit(0)).try_cast("bigint").alias("a"), F.get(parts, F.lit(1)).try_cast("bigint").alias("b"))
