"""Codes and markets as column expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

# The market of two leading digits (they go first) and of one digit; 0 and 1 are used by two markets
# and stand for sz; the markets; the three digits that indexes start with; indexes that have names.
TWO = {"92": "bj", "88": "sh", "81": "bj", "82": "bj"}
ONE = {"6": "sh", "5": "sh", "9": "sh", "4": "bj", "8": "bj", "2": "sz", "3": "sz"}
SHARED, DEFAULT = ("0", "1"), "sz"
MARKETS = ("sh", "sz", "bj", "hk", "us", "sw")
INDEX_DIGITS = {"sh": "000", "sz": "399", "bj": "899"}
INDEX_NAMES = {"hk": ("hsi", "hstech"), "us": ("dji", "ixic")}
# What a code looks like in the markets that digits alone never name.
FOREIGN = {"hk": "[0-9]{5}|[a-z]{1,10}", "us": "[a-z][a-z0-9.-]{0,9}", "sw": "801[0-9]{3}"}


def lookup(key, table: dict[str, str]) -> F.Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def clean(code) -> F.Column:
    return F.lower(F.trim(F.coalesce(code, F.lit(""))))


def market_of_digits(digits, default: str | None = DEFAULT) -> F.Column:
    """The market that bare digits resolve to."""
    return F.coalesce(lookup(F.substring(digits, 1, 2), TWO), lookup(F.substring(digits, 1, 1), ONE), F.lit(default))


def prefix_of(code) -> F.Column:
    """The market before the dot, or null."""
    head = F.split_part(clean(code), F.lit("."), F.lit(1))
    return F.when(clean(code).contains(".") & head.isin(*MARKETS), head)


def bare(code) -> F.Column:
    t = clean(code)
    return F.when(t.contains("."), F.substring_index(t, ".", -1)).otherwise(t)


def market_of(code) -> F.Column:
    """The market of a store key: its prefix, else what its digits say."""
    return F.coalesce(prefix_of(code), market_of_digits(clean(code)))


def store_key(code) -> F.Column:
    """market.digits without the prefix where the bare digits mean the same market."""
    p = prefix_of(code)
    return F.when(p.isin("sh", "sz", "bj") & (market_of_digits(bare(code)) == p), bare(code)).otherwise(clean(code))


def normalize_code(text) -> F.Column:
    """A store key from what a user may write (600000, sh600000, SH.600000, 600000.SH, hk.00700, us.dji, sw.801120).

    A prefix and a suffix that differ, or a form that no market has, give null.
    """
    t = clean(text)
    head, digits, tail = (F.regexp_extract(t, r"^(sh|sz|bj)?\.?([0-9]{6})(?:\.(sh|sz|bj))?$", i) for i in (1, 2, 3))
    said = F.coalesce(F.nullif(head, F.lit("")), F.nullif(tail, F.lit("")))
    clash = (head != "") & (tail != "") & (head != tail)
    known = market_of_digits(digits, None).isNotNull() | is_ambiguous(digits) | said.isNotNull()
    foreign = F.lit(None).cast("string")
    for market, form in FOREIGN.items():
        own = F.regexp_extract(t, rf"^{market}\.?\s*({form})$", 1)
        foreign = F.when(own != "", F.concat(F.lit(f"{market}."), own)).otherwise(foreign)
    home = F.when((digits == "") | clash | ~known, None).when(said.isNull() | (said == market_of_digits(digits)), digits).otherwise(F.concat(said, F.lit("."), digits))
    return F.coalesce(foreign, home)


def is_hk(key) -> F.Column:
    return F.coalesce(prefix_of(key) == "hk", F.lit(False))


def is_us(key) -> F.Column:
    return F.coalesce(prefix_of(key) == "us", F.lit(False))


def is_ambiguous(digits) -> F.Column:
    """Bare digits that two markets use."""
    return F.substring(clean(digits), 1, 1).isin(*SHARED)


def is_index(key) -> F.Column:
    """The index digits of a market, or a named index."""
    m = market_of(key)
    digits = F.coalesce(F.substring(bare(key), 1, 3) == lookup(m, INDEX_DIGITS), F.lit(False))
    named = F.lit(False)
    for market, names in INDEX_NAMES.items():
        named |= (prefix_of(key) == market) & bare(key).isin(*names)
    return digits | F.coalesce(named, F.lit(False))


def is_sw(key) -> F.Column:
    """Industry boards: sw. and six digits from 801."""
    return clean(key).rlike(r"^sw\.801[0-9]{3}$")


def is_a_share(key) -> F.Column:
    """Keys of the mainland markets, with or without prefix."""
    p = prefix_of(key)
    return F.when(clean(key).contains("."), F.coalesce(p.isin("sh", "sz", "bj"), F.lit(False))).otherwise((clean(key) != "") & (market_of_digits(clean(key), None).isNotNull() | is_ambiguous(key)))
