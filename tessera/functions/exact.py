"""Sums of doubles that don't depend on their order.

A double is an integer times a power of two. Its integer is cut into limbs of
LIMB bits at fixed places; limbs of the same place are added as integers, in
any order and any number of parts, without rounding. Only the whole sum is
rounded, once. Squares are summed the same way.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np

LIMB = 32


def _add(parts: dict[int, int], integers: np.ndarray, exponents: np.ndarray) -> None:
    """Add integers (below 2^63) times powers of two, given by place, 2^20 numbers at most."""
    sign, size = np.sign(integers).astype(np.float64), np.abs(integers).astype(np.uint64)
    place, shift = np.divmod(exponents, LIMB)
    low = (size & np.uint64(0xFFFFFFFF)) << shift.astype(np.uint64)
    high = ((size >> np.uint64(LIMB)) << shift.astype(np.uint64)) + (low >> np.uint64(LIMB))
    first = int(place.min())
    for k, limb in enumerate((low & np.uint64(0xFFFFFFFF), high & np.uint64(0xFFFFFFFF), high >> np.uint64(LIMB))):
        # Limbs are below 2^32, so sums of 2^20 of them are exact as doubles.
        for i, total in enumerate(np.bincount(place - first, weights=limb.astype(np.float64) * sign).tolist(), first + k):
            if total:
                parts[i] = parts.get(i, 0) + int(total)


def parts_of(values: np.ndarray) -> tuple[dict[int, int], dict[int, int]]:
    """Limb sums by place of finite ``values`` and of their squares."""
    sums: dict[int, int] = {}
    squares: dict[int, int] = {}
    for at in range(0, len(values), 1 << 20):
        fraction, exponent = np.frexp(values[at : at + (1 << 20)])
        integers, exponents = (fraction * 2.0**53).astype(np.int64), exponent.astype(np.int64) - 53
        _add(sums, integers, exponents)
        size = np.abs(integers)
        high, low = size >> 27, size & ((1 << 27) - 1)
        _add(squares, high * high, 2 * exponents + 54)
        _add(squares, 2 * high * low, 2 * exponents + 27)
        _add(squares, low * low, 2 * exponents)
    return sums, squares


def total(parts: dict[int, int]) -> Fraction:
    """The exact sum of limbs."""
    if not parts:
        return Fraction(0)
    first = min(parts)
    whole = sum(n << (LIMB * (k - first)) for k, n in parts.items())
    return Fraction(whole) * Fraction(2) ** (LIMB * first)


def rounded(value: Fraction) -> float:
    """The nearest double; infinite where there is none."""
    try:
        return float(value)
    except OverflowError:
        return math.copysign(math.inf, value)


def statistics(count: int, sums: dict[int, int], squares: dict[int, int]) -> tuple[float, float, float]:
    """Mean, sum and population standard deviation of ``count`` values, each rounded from its exact value."""
    s = total(sums)
    variance = (count * total(squares) - s * s) / (count * count)
    return rounded(s / count), rounded(s), root(variance)


def root(value: Fraction) -> float:
    """The square root of a fraction to double precision, also where the fraction itself is out of range."""
    if not value:
        return 0.0
    n, d = value.numerator, value.denominator
    shift = 2 * (64 - (n.bit_length() - d.bit_length()) // 2)  # so that the root has about 64 bits
    whole = math.isqrt((n << shift) // d if shift >= 0 else n // (d << -shift))
    return rounded(Fraction(whole) * Fraction(2) ** (-shift // 2))
