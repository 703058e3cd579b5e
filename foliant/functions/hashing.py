"""Content hashes: exact identity and 64-bit perceptual hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BITS = 8  # two hashes this close are the same image
HASH_VERSION = 2  # raise when the hash computation changes
LOGO_MAX_BYTES = 150 * 1024
SMALL_BYTES = 3 * 1024
MIN_CONVERSATIONS = 3


def content_sha(content: Column) -> Column:
    return F.sha2(content, 256)


def hex_to_long(h: Column) -> Column:
    """A 16-digit hex hash as a signed 64-bit number with the same bits."""
    def half(start: int) -> Column:
        return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")

    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def long_to_hex(n: Column) -> Column:
    return F.lower(F.lpad(F.hex(n), 16, "0"))


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two 64-bit numbers."""
    return F.bit_count(a.bitwiseXOR(b))


def dhash_from_luma(luma: Column, variant: str = "desktop") -> Column:
    """Difference hash of a 9x8 row-major brightness array, or NULL.

    A bit is set where a pixel is darker than its right neighbour (the browser
    variant: brighter). Nearly uniform pictures (fewer than 10 or more than 54
    set bits) get no hash, because they would all look alike.
    """
    def bit(i: Column) -> Column:
        at = F.floor(i / 8) * 9 + i % 8 + 1
        left, right = F.element_at(luma, at.cast("int")), F.element_at(luma, (at + 1).cast("int"))
        return (left > right if variant == "web" else left < right).cast("bigint")

    bits = F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"),
        lambda acc, i: F.shiftleft(acc, 1).bitwiseOR(bit(i)),
    )
    return F.when(F.bit_count(bits).between(10, 54), long_to_hex(bits))
