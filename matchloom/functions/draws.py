"""Random draws that any engine, layout or retry repeats: MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = 32


def hash_hex(seed: str, *keys: Column) -> Column:
    """32 lower-case hex digits, evenly spread. Comparing two of them as strings
    compares them as numbers."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[k.cast("string") for k in keys]))


def hash_below(seed: str, key: Column, fraction: float) -> Column:
    """True for the given share of the keys."""
    if not 0.0 <= fraction <= 1.0:
        raise ValueError("fraction must lie in [0, 1]")
    edge = int(fraction * 2**32)
    if edge >= 2**32:
        return F.lit(True)
    return F.substring(hash_hex(seed, key), 1, 8) < F.lit(f"{edge:08x}")


def hash_id(*keys: Column) -> Column:
    """128-bit id made of the keys, as 32 hex digits: the same in every layout, and as
    unique as they are. Each key is written with its length before it, a null as a dash, so that
    different keys never read alike."""

    def written(key: Column) -> Column:
        text = key.cast("string")
        return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.md5(F.concat(*[written(k) for k in keys]))


def hash_number(seed: str, *keys: Column) -> Column:
    """Evenly spread number below 2**32."""
    return F.conv(F.substring(hash_hex(seed, *keys), 1, 8), 16, 10).cast("bigint")


def hash_choice(seed: str, key: Column, options: list[str]) -> Column:
    """One of the options, drawn by the key."""
    choices = F.array(*[F.lit(o) for o in options])
    return F.element_at(choices, (hash_number(seed, key) % len(options) + 1).cast("int"))
