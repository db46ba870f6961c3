"""Random numbers as pure functions of a seed and of what a row is: a retry, another partitioning or SQL draws the same ones."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Shifts and odd factors below 2^31 of the mixing, so that products of 32 bits stay within 63.
ROUNDS = ((16, 0x7FEB352D), (15, 0x2C1B3C6D), (12, 0x297A2D39))
_LOW = 0xFFFFFFFF


def _once(h: Column, f) -> Column:
    """f(h) with h computed once, however often f names it: an expression that doubles at each step would grow without end."""
    return F.element_at(F.transform(F.array(h), f), 1)


def _round(shift: int, factor: int):
    return lambda x: (x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor)).bitwiseAND(F.lit(_LOW))


def _mixed(h: Column) -> Column:
    for shift, factor in ROUNDS:
        h = _once(h, _round(shift, factor))
    return _once(h, lambda x: x.bitwiseXOR(F.shiftright(x, 15)))


def bits(seed: int, *counters: Column) -> Column:
    """32 bits (a bigint) of the seed and of bigint counters, whose order counts."""
    h = F.lit(int(mixed(np.array([seed & _LOW], np.uint64))[0])).cast("bigint")
    for c in counters:
        c = c.cast("bigint")
        h = _mixed(h.bitwiseXOR(c.bitwiseAND(F.lit(_LOW))))
        h = _mixed(h.bitwiseXOR(F.shiftrightunsigned(c, 32)))
    return h


def uniform(seed: int, *counters: Column) -> Column:
    """At least 0, below 1."""
    return bits(seed, *counters) / F.lit(float(1 << 32))


def normal(seed: int, *counters: Column) -> Column:
    """Standard normal, from two uniforms (the first above 0) by the polar form of their logarithm and angle."""
    radius = F.sqrt(-2 * F.log((bits(seed, *counters, F.lit(1)) + 1) / F.lit(float(1 << 32))))
    return radius * F.cos(uniform(seed, *counters, F.lit(2)) * (2 * np.pi))


def mixed(h: np.ndarray) -> np.ndarray:
    for shift, factor in ROUNDS:
        h = ((h ^ (h >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(_LOW)
    return h ^ (h >> np.uint64(15))


def bits_of(seed: int, *counters: np.ndarray | int) -> np.ndarray:
    """bits() of arrays, inside a task."""
    h = mixed(np.array([seed & _LOW], np.uint64))
    for c in counters:
        c = np.asarray(c, np.int64).view(np.uint64) if np.ndim(c) else np.array([c], np.int64).view(np.uint64)
        h = mixed(h ^ (c & np.uint64(_LOW)))
        h = mixed(h ^ (c >> np.uint64(32)))
    return h


def bits_sql(seed: int, *counters: str) -> str:
    """bits() as SQL text."""

    def step(h: str) -> str:
        for shift, factor in ROUNDS:
            h = f"list_transform([{h}], lambda h{shift}: (xor(h{shift}, h{shift} >> {shift}) * {factor}) & {_LOW})[1]"
        return f"list_transform([{h}], lambda z: xor(z, z >> 15))[1]"

    h = f"{int(mixed(np.array([seed & _LOW], np.uint64))[0])}::BIGINT"
    for c in counters:
        h = step(f"xor({h}, ({c})::BIGINT & {_LOW})")
        h = step(f"xor({h}, (({c})::BIGINT >> 32) & {_LOW})")
    return h
