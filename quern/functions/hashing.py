"""Deterministic assignment by md5, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let


def md5_mod(key: Column, modulus: int) -> Column:
    """The md5 of ``key``, read as one 128-bit number, modulo ``modulus`` (folded from four 32-bit pieces)."""

    def fold(digest: Column) -> Column:
        out = F.lit(0).cast("long")
        for i in range(4):
            piece = F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long")
            out = (out * F.lit((1 << 32) % modulus) + piece) % F.lit(modulus)
        return out

    return let(F.md5(key.cast("binary")), fold)


def bucket(number: Column, bounds: list[tuple[int, str]], other: str) -> Column:
    """The name of the first bound that ``number`` is below, else ``other``."""

    def first(n: Column) -> Column:
        out = F.lit(other)
        for top, name in reversed(bounds):
            out = F.when(n < top, name).otherwise(out)
        return out

    return let(number, first)


def template(row_id: Column, constraint: Column) -> Column:
    """Prompt template: A for half of all keys, B for three tenths, C for the rest."""
    return bucket(md5_mod(F.concat(row_id, constraint), 100), [(50, "A"), (80, "B")], "C")


def richness(row_id: Column, constraint: Column) -> Column:
    """Richness tier: a tenth concise, seven tenths standard, the rest rich."""
    return bucket(md5_mod(F.concat(row_id, constraint, F.lit("richness")), 10), [(1, "concise"), (8, "standard")], "rich")


def coin(row_id: Column, constraint: Column) -> Column:
    """Whether the optional line of template C is written."""
    return md5_mod(F.concat(row_id, constraint, F.lit("opt")), 2) == 0
