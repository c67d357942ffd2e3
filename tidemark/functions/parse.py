"""Parsing of landed text fields. Bad input becomes null or empty, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.fixed_values import GAME_HOURS, UMBRELLA_LEAGUES
from tidemark.functions.numeric import col, finite


def json_strings(text) -> Column:
    """A JSON-encoded array as strings; anything else is empty (FN-6)."""
    return F.coalesce(F.from_json(col(text), "array<string>"), F.array().cast("array<string>"))


def json_numbers(text) -> Column:
    """A JSON-encoded array as finite doubles (FN-6)."""
    return F.filter(F.transform(json_strings(text), finite), lambda x: x.isNotNull())


def timestamp_of(text) -> Column:
    """ISO text as a timestamp (FN-7)."""
    return F.try_to_timestamp(col(text))


def unix_timestamp_of(seconds) -> Column:
    """Positive unix seconds as a timestamp (FN-7)."""
    seconds = finite(seconds)
    return F.when(seconds > 0, F.timestamp_seconds(seconds))


def kickoff_of(text) -> Column:
    """Kickoff text, with a space separator, a short offset or no offset at all (FN-8).

    Relies on the session time zone being UTC, which is what a missing offset stands for.
    """
    return F.trim(col(text)).try_cast("timestamp")


def wallet_of(text) -> Column:
    return F.lower(F.trim(col(text)))


def is_wallet(text) -> Column:
    """40 hex digits after 0x (FN-10)."""
    return F.trim(col(text)).rlike("^0x[a-fA-F0-9]{40}$")


def slug_of(text) -> Column:
    """Lower-case words joined by single dashes (FN-11)."""
    dashed = F.regexp_replace(F.lower(F.trim(col(text))), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def curve_of(text) -> Column:
    """A stored JSON curve as array<struct<t, p>>, malformed points dropped (FN-17)."""
    points = F.from_json(col(text), "array<struct<t:double,p:double>>")
    usable = F.filter(points, lambda x: finite(x.t).isNotNull() & finite(x.p).isNotNull())
    return F.coalesce(usable, F.array().cast("array<struct<t:double,p:double>>"))


def league_of(tags) -> Column:
    """League slug among tags: a specific one before an umbrella one (FN-13)."""
    slugs = F.transform(col(tags), lambda t: F.lower(F.trim(t)))
    known = F.filter(slugs, lambda s: s.isin(list(GAME_HOURS)))
    specific = F.filter(known, lambda s: ~s.isin(UMBRELLA_LEAGUES))
    return F.coalesce(F.get(specific, F.lit(0)), F.get(known, F.lit(0)))


def resolved_outcome(prices, closed) -> Column:
    """Index of the one price equal to 1 on a closed market (PRJ-22)."""
    prices = col(prices)
    hits = F.filter(F.transform(prices, lambda p, i: F.when(F.abs(p - 1.0) < 1e-9, i)),
                    lambda i: i.isNotNull())
    return F.when(col(closed) & (F.size(hits) == 1), F.get(hits, F.lit(0)))


def won_of(settlement_price) -> Column:
    """True near 1, false near 0, else unknown (PRJ-22)."""
    price = col(settlement_price)
    return F.when(F.abs(price - 1.0) < 1e-6, True).when(F.abs(price) < 1e-6, False)
