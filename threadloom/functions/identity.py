"""Identifiers and content hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uuid_key(c: Column | str) -> Column:
    """A uuid without case, hyphens, braces and outer blanks; null where nothing remains."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.translate(F.trim(c), "-{}", ""))
    return F.when(F.length(bare) > 0, bare)


def uuid_text(key: Column) -> Column:
    """A 32-digit key in lower case with hyphens; other keys as they are."""
    dashed = F.regexp_replace(key, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return F.when(key.isNotNull(), dashed)


def squeeze(c: Column | str) -> Column:
    """Text without outer white space and with each run of white space as one space; null gives ''."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def speaker(c: Column | str) -> Column:
    """human or assistant, from any of their spellings; null for whoever is no speaker."""
    c = F.col(c) if isinstance(c, str) else c
    bare = F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.when(bare.isin("human", "user"), "human").when(bare.isin("assistant", "model"), "assistant")


def message_hash(sender: Column | str, text: Column | str) -> Column:
    """Hex SHA-256 of role::text. A sender who is no speaker counts with the sender's own trimmed spelling, null as ''."""
    sender = F.col(sender) if isinstance(sender, str) else sender
    role = F.coalesce(speaker(sender), F.trim(sender), F.lit(""))
    return F.sha2(F.concat(role, F.lit("::"), squeeze(text)), 256)
