"""Identifiers: repeatable, so a re-run of a batch writes the same keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def surrogate_id(kind: str | Column, source_id: Column) -> Column:
    """Row id of a projection: a hash of its kind and natural key."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.substring(F.sha2(F.concat(kind, F.lit(":"), source_id.cast("string")), 256), 1, 32)


def time_ordered_id(ts: Column, seed: Column) -> Column:
    """UUID version 7: 48 bits of Unix milliseconds, then version, variant and hash bits.

    The hash of ``seed`` stands in for random bits, so retried tasks agree.
    """
    millis = F.lpad(F.lower(F.hex(F.unix_millis(ts))), 12, "0")
    bits = F.sha2(seed.cast("string"), 256)
    # The variant nibble is 8, 9, a or b: two fixed bits and two free ones.
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(bits, 4, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(millis, 1, 8), F.lit("-"), F.substring(millis, 9, 4),
        F.lit("-7"), F.substring(bits, 1, 3),
        F.lit("-"), variant, F.substring(bits, 5, 3),
        F.lit("-"), F.substring(bits, 8, 12),
    )


def event_checksum(payload: Column) -> Column:
    """Traceability digest of the payload text; never used to suppress a write."""
    return F.sha2(payload, 256)
