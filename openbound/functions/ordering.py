"""Deterministic pseudo-random orderings.

The reference draws with numpy/torch generators; results here must be
reproducible and recomputable after an executor loss, so randomness is a pure
function of (id, seed).  ``mix_key`` is a Lehmer-style permutation of ids
below 2**31-1 that stays inside 63-bit arithmetic (no overflow under ANSI
mode) and has an identical SQL twin (see ``MIX_SQL``), so sampled rows can be
checked by an independent SQL engine.  Ties (ids >= 2**31-1 only) are broken
by the id itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: modulus and multipliers of the ordering mix
MIX_MOD = 2147483647
MIX_A = 48271
MIX_B = 69621


def mix_key(id_col, seed: int) -> Column:
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    c = c.cast("long")
    return ((c % MIX_MOD) * MIX_A + (F.call_function("div", c, F.lit(MIX_MOD)) % MIX_MOD) * MIX_B
            + F.lit(int(seed) % MIX_MOD)) % MIX_MOD


def mix_sql(id_expr: str, seed: int) -> str:
    """SQL twin of :func:`mix_key` (DuckDB / ANSI)."""
    return (f"((({id_expr}) % {MIX_MOD}) * {MIX_A} + ((({id_expr}) // {MIX_MOD}) % {MIX_MOD}) * {MIX_B}"
            f" + {int(seed) % MIX_MOD}) % {MIX_MOD}")


def mix_value(i: int, seed: int) -> int:
    """Driver-side twin of :func:`mix_key` for small label-level tables."""
    i = int(i)
    return ((i % MIX_MOD) * MIX_A + ((i // MIX_MOD) % MIX_MOD) * MIX_B + int(seed) % MIX_MOD) % MIX_MOD
