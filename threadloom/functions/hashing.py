"""Content hashes of the model, all hex SHA-256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions.text import normalize_content, normalize_phrase


def conversation_hash(*columns: str) -> Column:
    """Of the record's canonical JSON (fields in the given order, nulls left out)."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def role_hash(role: Column | str, text: Column | str) -> Column:
    """Of role::text with the text's white space normalised."""
    return F.sha2(F.concat_ws("::", F.col(role) if isinstance(role, str) else role, normalize_content(text)), 256)


def fragment_hash(message_id: Column | str, order: Column | str, text: Column | str) -> Column:
    """Of message::order::text."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in (message_id, order)]
    return F.sha2(F.concat_ws("::", *parts, normalize_content(text)), 256)


def phrase_hash(phrase: Column | str) -> Column:
    return F.sha2(normalize_phrase(phrase), 256)
