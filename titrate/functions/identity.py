"""Content-derived identities: replaying the same input gives the same keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Identity prefixes by kind and protocol.
RECEIPT_PREFIX = "recv-v1:"
FILE_RECEIPT_PREFIX = "recv-file-v1:"
DELIVERY_PREFIX = {"ASTM": "astm-v1", "HL7": "hl7-v1", "CSV": "file-v1", "FILE": "file-v1"}


def content_hash(content: Column) -> Column:
    """SHA-256 hex of the UTF-8 text or the bytes."""
    return F.sha2(content, 256)


def _nul() -> Column:
    return F.decode(F.unhex(F.lit("00")), "UTF-8")


def receipt_id(source: Column, raw_hash: Column) -> Column:
    return F.concat(F.lit(RECEIPT_PREFIX), F.sha2(F.concat(source, _nul(), raw_hash), 256))


def file_receipt_id(connection: Column, raw_hash: Column) -> Column:
    return F.concat(F.lit(FILE_RECEIPT_PREFIX), F.sha2(F.concat(connection, _nul(), raw_hash), 256))


def _length_prefixed(value: Column) -> Column:
    length = F.unhex(F.lpad(F.hex(F.octet_length(value)), 8, "0"))
    return F.concat(length, F.encode(value, "UTF-8"))


def delivery_id(protocol: Column, connection: Column, raw_hash: Column, accession: Column) -> Column:
    """``<prefix>:sha256`` over the three length-prefixed parts; NULL when a part is blank."""
    prefix = F.element_at(
        F.create_map(*[F.lit(x) for pair in DELIVERY_PREFIX.items() for x in pair]), protocol
    )
    parts = [connection, raw_hash, accession]
    present = F.lit(True)
    for p in parts:
        present = present & F.coalesce(p.rlike(r"\P{javaWhitespace}"), F.lit(False))
    digest = F.sha2(F.concat(*[_length_prefixed(p) for p in parts]), 256)
    return F.when(present, F.concat(prefix, F.lit(":"), digest))


def entry_uuid(delivery: Column, ordinal: Column | str) -> Column:
    """A UUID-shaped id derived from the delivery and a position, so that reruns give identical bundles."""
    pos = F.lit(ordinal) if isinstance(ordinal, str) else ordinal.cast("string")
    h = F.sha2(F.concat(delivery, F.lit("/"), pos), 256)
    # The digest is mentioned once: in branches of a condition each mention would be computed.
    return F.coalesce(F.regexp_replace(h, r"\A(.{8})(.{4})(.{4})(.{4})(.{12}).*\z", "$1-$2-$3-$4-$5"), F.lit(""))


def unit_fraction(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key only (stands where a random draw would stand)."""
    return F.pmod(F.xxhash64(*key), F.lit(1_000_003)) / F.lit(1_000_003.0)
