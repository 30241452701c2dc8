"""Deterministic draws that survive recomputation: functions of a row's id, never of its place."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(column: Column, salt: str) -> Column:
    """A number in (0, 1), fixed by the id and the salt; 52 bits of an MD5 digest, centred in their cell."""
    digest = F.md5(F.concat(F.lit(f"{salt}:"), F.coalesce(column.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def remainder(column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
