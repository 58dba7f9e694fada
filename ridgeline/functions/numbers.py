"""Numbers that come out the same in every engine."""

from __future__ import annotations

from pyspark.sql import functions as F


def round_half_up(x, digits: int = 4) -> F.Column:
    """Rounding that other engines repeat bit by bit: floor(x * 10^d + 0.5) / 10^d."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


# The daily price limit by the first digits of a bare code; all others have the last one.
LIMITS = {"300": 0.2, "301": 0.2, "688": 0.2, "689": 0.2, "4": 0.3, "8": 0.3, "": 0.1}


def limit_of(digits: str) -> float:
    return next(share for start, share in LIMITS.items() if digits.startswith(start))


def limit_pct(code) -> F.Column:
    """The daily price limit of a bare code: 20% for the growth boards, 30% for codes from 4 or 8, else 10%."""
    out = F.lit(LIMITS[""])
    for start, share in LIMITS.items():
        out = F.when(code.startswith(start), share).otherwise(out) if start else out
    return out


def commission(amount, rate: float = 0.00025, least: float = 5.0) -> F.Column:
    return F.greatest(F.lit(least), amount * rate)
