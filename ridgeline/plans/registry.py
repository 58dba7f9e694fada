"""Queries of the engine's own operators by name, with the SQL that gives the same rows.

A query without SQL is one that SQL cannot express in practice (segments and
what follows from them, ledgers, streams, binary files); tests hold those
against hand-made cases and invariants.
"""

from __future__ import annotations

from ridgeline.plans import market, relational, structural

_PARTS = (relational, structural, market)


def queries() -> dict:
    out: dict = {}
    for part in _PARTS:
        out |= part.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for part in _PARTS:
        out |= part.SQL
    return out


