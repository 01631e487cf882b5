"""Random draws that are a pure function of (seed, step, key).

``F.rand`` and ``F.randn`` depend on the partition layout and are redrawn when
a partition is recomputed. These draws depend on the row's key alone, so a lost
executor, a different cluster size or a second read give the same numbers.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

HASHES = ("xxhash64", "md5")


@dataclass(frozen=True)
class Noise:
    """``xxhash64`` stays in primitive codegen and is about ten times cheaper;
    ``md5`` gives draws that any SQL engine can recompute."""

    seed: int
    hash: str = "xxhash64"

    def __post_init__(self) -> None:
        if self.hash not in HASHES:
            raise ValueError(f"hash must be one of {HASHES}, not {self.hash!r}")

    def _digest(self, step: Column | int, keys: tuple) -> Column:
        parts = [F.lit(self.seed).cast("string"), _column(step).cast("string"), *map(_told_apart, keys)]
        return F.md5(F.concat_ws(":", *parts).cast("binary"))

    def _hash53(self, lane: int, step: Column | int, keys: tuple) -> Column:
        head = [F.lit(self.seed), F.lit(lane), _column(step)]
        parts = [p.cast("bigint") for p in head]
        for key in map(_column, keys):
            # the hash passes over NULLs, so each key says whether it is one
            parts += [key.isNull(), key]
        return F.shiftrightunsigned(F.xxhash64(*parts), 11)

    def bits32(self, step: Column | int, *keys: Column | str) -> Column:
        """A 32-bit unsigned integer, as BIGINT."""
        if self.hash == "md5":
            return _hex(self._digest(step, keys), 1, 8)
        return F.shiftrightunsigned(self._hash53(0, step, keys), 21)

    def uniform(self, step: Column | int, *keys: Column | str) -> Column:
        """A double in [0, 1)."""
        return self.bits32(step, *keys).cast("double") / F.lit(float(2**32))

    def gaussian(self, step: Column | int, *keys: Column | str) -> Column:
        """A standard normal double (Box-Muller)."""
        if self.hash == "md5":
            digest = self._digest(step, keys)
            u1 = (_hex(digest, 1, 12) + F.lit(1)).cast("double") / F.lit(float(2**48 + 1))
            u2 = _hex(digest, 13, 12).cast("double") / F.lit(float(2**48))
        else:
            scale = F.lit(2.0**-53)
            u1 = (self._hash53(1, step, keys).cast("double") + F.lit(0.5)) * scale
            u2 = self._hash53(2, step, keys).cast("double") * scale
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def _column(value: Column | str | int) -> Column:
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def _told_apart(key: Column | str | int) -> Column:
    """A key as text that no other list of keys spells alike: its length goes
    before it, and NULL is a text of its own."""
    text = _column(key).cast("string")
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.length(text).cast("string"), F.lit("="), text))


def _hex(digest: Column, start: int, length: int) -> Column:
    return F.conv(F.substring(digest, start, length), 16, 10).cast("bigint")
