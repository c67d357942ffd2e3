"""Text scans: resolution clarity, category from tags or question, quoted lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import fixed_values as V
from tidemark.functions.numeric import clamp, col
from tidemark.functions.parse import slug_of


# Word boundaries between ASCII word characters only, whatever the JVM takes ``\\b`` to mean.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def _found(text: Column, pattern: str) -> Column:
    return text.rlike("(?i)" + pattern.replace(r"\b", BOUNDARY))


def resolution_clarity(description, source) -> dict[str, Column]:
    """Objectivity of resolution criteria, 0..100, with flag codes (PRJ-14)."""
    text = F.regexp_replace(F.coalesce(col(description), F.lit("")), r"^\s+|\s+$", "")
    length = F.length(text)
    short_at, short_points, short_flag = V.CLARITY_SHORT
    long_at, long_points = V.CLARITY_LONG
    points = F.lit(V.CLARITY_BASE)
    points = points + F.when(length < short_at, short_points).when(length > long_at, long_points) \
        .otherwise(0)
    sourced = F.length(F.trim(F.coalesce(col(source), F.lit("")))) > 0
    points = points + F.when(sourced, V.CLARITY_SOURCE).otherwise(0)
    flags = [F.when(length < short_at, short_flag)]
    for pattern, flag, worth in V.AMBIGUITY_TERMS:
        hit = _found(text, pattern)
        points = points + F.when(hit, worth).otherwise(0)
        flags.append(F.when(hit, flag))
    for pattern, worth in V.CLARITY_TERMS:
        points = points + F.when(_found(text, pattern), worth).otherwise(0)
    empty = length == 0
    score = F.when(empty, float(V.CLARITY_UNPUBLISHED)).otherwise(
        clamp(points.cast("double"), 0.0, 100.0))
    return {"clarity_score": score,
            "clarity_flags": F.when(empty, F.array(F.lit("UNPUBLISHED"))).otherwise(
                F.array_compact(F.array(*flags)))}


def quoted_line(question) -> Column:
    """The number in an over/under or a parenthesised spread (PRJ-26)."""
    question = col(question)
    total = F.regexp_extract(question, r"(?i)O/U\s*([+-]?\d+(?:\.\d+)?)", 1)
    spread = F.regexp_extract(question, r"\(\s*([+-]\d+(?:\.\d+)?)\s*\)", 1)
    return F.coalesce(total.try_cast("double"), spread.try_cast("double"))


def spread_team(question) -> Column:
    """The team a spread is quoted against (PRJ-26)."""
    team = F.trim(F.regexp_extract(col(question), r"(?i)Spread:\s*(.+?)\s*\(", 1))
    return F.when(team != "", team)


def _listed_runs(parts: Column, words: list[str]) -> Column:
    """Runs of consecutive parts of a slug that are listed words, each once.

    A listed word matches a slug exactly when it equals a run of the slug's dash-separated parts.
    Single parts are looked up directly and longer runs are only put together where a listed word
    begins, so what leaves this expression is a handful of hits per text.
    """
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(word.count("-") + 1, []).append(word)

    def runs_of(n: int, listed: list[str]) -> Column:
        if n == 1:
            return F.filter(parts, lambda part: part.isin(listed))
        first = sorted({word.split("-")[0] for word in listed})
        last_start = F.greatest(F.size(parts) - n + 1, F.lit(1))
        starts = F.filter(F.sequence(F.lit(1), last_start),
                          lambda at: F.element_at(parts, at).isin(first))
        runs = F.transform(starts, lambda at: F.array_join(F.slice(parts, at, F.lit(n)), "-"))
        return F.filter(runs, lambda run: run.isin(listed))

    return F.array_distinct(F.flatten(F.array(*[runs_of(n, w) for n, w in sorted(by_length.items())])))


def _best(scores: dict[str, Column]) -> Column:
    """The category with the highest positive score; of equal ones the first in the fixed order."""
    top = F.greatest(*scores.values())
    chosen = F.when(top <= 0, F.lit(None))
    for name in V.CATEGORY_ORDER:
        chosen = chosen.when(scores[name] == top, name)
    return chosen


def resolve_category(df: DataFrame, tags: str, question: str,
                     words: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with ``category``: weighted tags first, then the question text (FN-12).

    A row's category needs nothing but the row, so this is one projection: no join and no shuffle.
    """
    words = words or V.CATEGORY_WORDS
    listed = sorted({w for some in words.values() for w in some})
    given = F.filter(F.coalesce(F.col(tags), F.array().cast("array<string>")), lambda t: F.length(t) > 0)
    slugs = F.filter(F.transform(given, lambda t: slug_of(t)), lambda t: t != "")
    weighed = F.transform(slugs, lambda slug: F.struct(
        F.when(slug.isin(V.GENERIC_TAGS), V.GENERIC_TAG_WEIGHT).otherwise(V.SPECIFIC_TAG_WEIGHT).alias("weight"),
        _listed_runs(F.split(slug, "-"), listed).alias("hits")))
    # The intermediate arrays are columns, so that each category does not look for them again.
    names = {"_tag_hits": weighed, "_text_hits": _listed_runs(
        F.col("_parts"), [w for w in listed if len(w) >= V.PROSE_WORD_LENGTH])}
    staged = df.withColumn("_parts", F.split(slug_of(question), "-")).withColumns(names)

    def from_tags(name: str) -> Column:
        own = F.array(*map(F.lit, words[name]))
        return F.aggregate("_tag_hits", F.lit(0), lambda total, tag: total + F.when(
            F.arrays_overlap(tag["hits"], own), tag["weight"]).otherwise(0))

    def from_text(name: str) -> Column:
        return F.size(F.array_intersect("_text_hits", F.array(*map(F.lit, words[name]))))

    order = V.CATEGORY_ORDER
    fallback = F.when(F.size(given) > 0, "OTHER").otherwise("UNKNOWN")
    return staged.withColumn("category", F.coalesce(
        _best({n: from_tags(n) for n in order}),
        _best({n: F.coalesce(from_text(n), F.lit(0)) for n in order}), fallback)).drop("_parts", *names)
