"""Deterministic identifiers and hashes as Columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarena.functions.text import let

#: The namespace of generated identifiers; deployments set their own.
DEFAULT_NAMESPACE = uuid.UUID("12345678-1234-5678-1234-567812345678")


def uuid5(name: Column, namespace: uuid.UUID = DEFAULT_NAMESPACE) -> Column:
    """The version-5 UUID of a name, from SHA-1 alone: no UDF."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))

    def parts(h: Column) -> Column:
        variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
        last = F.concat(variant, F.substring(h, 18, 3))
        return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), last, F.substring(h, 21, 12))

    # inside another lambda Spark would work out the hash, and the name in it, for each of the parts
    return let(h, parts)


def pii_uuid(kind: str | Column, value: Column, namespace: uuid.UUID = DEFAULT_NAMESPACE) -> Column:
    """The identifier of a value of a kind; null for a null value."""
    return uuid5(F.concat(F.lit(kind) if isinstance(kind, str) else kind, F.lit(":"), value), namespace)


def content_sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def item_id(content: Column) -> Column:
    """The short identifier of a file: 12 hex digits of its SHA-256."""
    return F.substring(F.sha2(content, 256), 1, 12)


def prompt_version(content: Column) -> Column:
    """Eight hex digits of a prompt's SHA-1."""
    return F.substring(F.sha1(content), 1, 8)
