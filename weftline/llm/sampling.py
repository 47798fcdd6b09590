"""Bounded, repeatable samples of labelled rows, chosen by a hash of the row's key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.encode(key.cast("string"), "UTF-8")) % modulus


def bounded(rows: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those of the smallest hash of ``key``; all of them if there are no more.

    A count comes first, so that the order is taken of about ``most`` rows only.
    """
    total = rows.count()
    order = F.xxhash64(F.lit("sample"), F.col(key))
    if total > most:
        share = int(min(1.0, 1.1 * most / total + 100 / total) * 2**32)
        rows = rows.where(F.pmod(order, F.lit(2**32)) < share)
    return rows.orderBy(F.pmod(order, F.lit(2**32)), order, *rows.columns).limit(most)


#: Bytes of the texts of a sample together, and of one of them, at most; longer texts are not learned from.
SAMPLE_BYTES, LONGEST = 64 << 20, 1 << 20


def capped(rows: DataFrame, order: list[Column], size: str, most: int, most_bytes: int = SAMPLE_BYTES) -> list[Row]:
    """The first rows by ``order``, at most ``most``, as long as their ``size`` adds up to no more than ``most_bytes``."""
    total, out = 0, []
    for row in rows.orderBy(*order, *rows.columns).limit(most).collect():  # a few numbers for each of `most` rows
        if total + row[size] <= most_bytes:
            total += row[size]
            out.append(row)
    return out
