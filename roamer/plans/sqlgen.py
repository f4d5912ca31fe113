"""Small text helpers for writing the DuckDB oracle SQL."""

from __future__ import annotations


def r6(expr: str, digits: int = 6) -> str:
    """Half-even rounding at the query boundary, same rule as the Spark side."""
    scale = f"{10 ** digits}.0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def heven(expr: str, digits: int = 0) -> str:
    if digits == 0:
        return f"round_even(({expr}), 0)"
    scale = f"{10 ** digits}.0"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def clip(expr: str, lo: float | None = None, hi: float | None = None) -> str:
    out = expr
    if lo is not None:
        out = f"greatest({out}, {lo})"
    if hi is not None:
        out = f"least({out}, {hi})"
    return f"CASE WHEN ({expr}) IS NULL THEN NULL ELSE {out} END"


def strip(expr: str) -> str:
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"
