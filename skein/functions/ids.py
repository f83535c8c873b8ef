"""Deterministic identifiers as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein.functions.text import slug

#: The DNS namespace of RFC 4122.
DNS = "6ba7b8109dad11d180b400c04fd430c8"


def uuid5(name: Column) -> Column:
    """RFC 4122 version 5 in the DNS namespace."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(DNS)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12))


def fact_id(content: Column, user: str = "app_user") -> Column:
    return uuid5(F.concat(F.lit(f"{user}:"), F.md5(content)))


def pathway_id(key_terms: Column) -> Column:
    """Key terms with the same first 80 characters share an id: the later one wins."""
    return uuid5(F.concat(F.lit("pathway:"), F.substring(key_terms, 1, 80)))


def chunk_id(chapter: Column, index: Column, chunk: Column) -> Column:
    return uuid5(F.concat(F.lit("rag:"), chapter.cast("string"), F.lit(":"), index.cast("string"), F.lit(":"), F.substring(chunk, 1, 40)))


def seed_id(name: Column) -> Column:
    return uuid5(F.concat(F.lit("graphrag:"), F.lower(name)))


def stable_doc_id(source: Column, index: Column) -> Column:
    """First 14 hex digits of the SHA-256 of ``source:index`` modulo 2^31 - 1."""
    h = F.sha2(F.concat_ws(":", source, index.cast("string")), 256)
    return F.pmod(F.conv(F.substring(h, 1, 14), 16, 10).cast("bigint"), F.lit(2147483647))


def entity_id(name: Column) -> Column:
    """Slug and eight hex digits of a hash: one name, one id, on every run."""
    return F.concat(F.lit("entity_"), slug(name), F.lit("_"), F.substring(F.sha2(name, 256), 1, 8))


def event_id(title: Column, doc: Column, position: Column) -> Column:
    h = F.sha2(F.concat_ws(":", title, doc.cast("string"), position.cast("string")), 256)
    return F.concat(F.lit("evt_"), slug(title), F.lit("_"), F.substring(h, 1, 8))
