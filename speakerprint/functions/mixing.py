"""Seeded arithmetic mixer used wherever a reproducible draw is needed.

The mixer is plain 64-bit integer arithmetic, so the same draw comes out of Spark SQL,
numpy and any other SQL engine, whatever the partitioning. The squarings matter: a purely
linear congruence leaves rows of the sign matrix correlated.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixer.
MODULUS = 2147483647
STEP_A = 7919
STEP_B = 104729
OFFSET = 12345
STEP_C = 48271


def mix_sql(a: str, b: str) -> str:
    """SQL text of ``mix(a, b)`` in [0, 2^31-1) for non-negative integers a and b."""
    x = (
        f"(((CAST({a} AS BIGINT) % {MODULUS}) * {STEP_A} + (CAST({b} AS BIGINT) % {MODULUS}) * {STEP_B}"
        f" + {OFFSET}) % {MODULUS})"
    )
    y = f"((({x} * {x}) % {MODULUS} * {STEP_C} + {x}) % {MODULUS})"
    return f"(({y} * {y}) % {MODULUS})"


def pick_sql(a: str, b: str, n: str) -> str:
    """SQL text of a draw in [0, n); two mixes give 62 bits, enough for any row count."""
    return f"(({mix_sql(a, b)} * {MODULUS} + {mix_sql(a, f'({b}) + 1000003')}) % ({n}))"


def coin_sql(a: str, b: str, div: str = "div") -> str:
    """SQL text of a fair 0/1 draw. ``div`` is the integer-division operator of the engine."""
    return f"(({mix_sql(a, b)} {div} 65536) % 2)"


def mix(a: str, b: str) -> Column:
    return F.expr(mix_sql(a, b))


def pick(a: str, b: str, n: str) -> Column:
    return F.expr(pick_sql(a, b, n))


def coin(a: str, b: str) -> Column:
    return F.expr(coin_sql(a, b)).cast("int")


def mix_array(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """numpy form of ``mix`` on broadcastable int64 arrays."""
    x = ((a % MODULUS) * STEP_A + (b % MODULUS) * STEP_B + OFFSET) % MODULUS
    y = ((x * x) % MODULUS * STEP_C + x) % MODULUS
    return (y * y) % MODULUS
