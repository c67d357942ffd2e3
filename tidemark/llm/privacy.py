"""Personal data: found by pattern, and by how much other terms disclose it.

Base spans are emails, IP addresses, cards (Luhn) and phone numbers. Each pattern is read once for its
matches and once for what lies between them, which gives the places in code points.

Terms are words of three letters or more outside base spans. Over the whole corpus, a term t discloses
the protected value e by its pointwise mutual information, log p(e, t) / (p(e) p(t)), compared with the
information of e itself, -log p(e): from ``GENERALISE`` of it on the term is generalised to its kind, from
``REMOVE`` on it is removed, wherever it stands in any text. All three p count distinct whole texts, so
copies of a text prove nothing, and fewer than ``SEEN`` texts with both are no evidence.

A term in more than ``n ** (1 - GENERALISE) * with_value ** GENERALISE`` of n texts can't reach the threshold
even if every text with the value has it; such pairs are dropped before they are counted.

Everything is DataFrame functions. The patterns are those of the contract with loops that don't back
up (Java's possessive form), and start where a run of their characters starts or the last match ended,
so that very long runs cost one pass.

* Null texts are empty: no spans. Null doc_ids keep their row. Repeated rows count as one text. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, text_of
from tidemark.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:(?<!{LOCAL})|\\G){LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:(?<![0-9])|\\G)[0-9]++\\.[0-9]++\\.[0-9]++\\.[0-9]++",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
WORDS = "\\p{L}{3,}+"
SPANS = "array<struct<start:int,order:int,end:int,share:double>>"
SEEN = 3
GENERALISE, REMOVE = 0.8, 0.95
#: Rows to join with the texts, up to so many bytes of ids or words, are sent to them; more are joined by a
#: shuffle, with the same result.
MOST_SENT = 16 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the last digit is the Luhn check of the others."""
    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), lambda d, i: F.when(
        i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        parts = F.split(value, "\\.")
        trimmed = F.transform(parts, lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(trimmed, lambda p: (F.length(p) <= 3) & (p.try_cast("int") <= 255))
    digits = F.length(_digits(value))
    if kind == "phone":
        return digits.between(9, 15)
    return digits.between(12, 19) & luhn(_digits(value))


def spans_of(text: Column, kind: str, pattern: str) -> Column:
    """Array of (start, order, end, value) of the pattern's matches, in code points, end exclusive."""
    order = KINDS.index(kind) if kind in KINDS else len(KINDS)
    empty = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(
        "array<struct<start:int,order:int,end:int,value:string>>").alias("out"))
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), F.length)
    pairs = F.arrays_zip(F.transform(gaps, lambda g: g).alias("gap"), matches.alias("value"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        one = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), pair["value"].alias("value"))
        return F.when(pair["value"].isNull(), state).otherwise(
            F.struct(end.alias("at"), state["i"].alias("i"), F.concat(state["out"], F.array(one)).alias("out")))

    return F.aggregate(pairs, empty, add, lambda s: s["out"])


def base_spans(text: Column) -> Column:
    """All base spans, by start and kind."""
    def found(kind: str, quick: str) -> Column:
        held = F.filter(spans_of(text, kind, PATTERNS[kind]), lambda s: _holds(kind, s["value"]))
        return F.when(F.regexp_like(text, F.lit(quick)), held).otherwise(
            F.array().cast("array<struct<start:int,order:int,end:int,value:string>>"))

    quick = ("@", "[0-9]\\.[0-9]", "[0-9][\\x20-]?[0-9]", "\\+[0-9]")
    return F.array_sort(F.concat(*map(found, KINDS, quick)))


def kind_of(order: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, (*KINDS, "term"))), order + 1)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", kind_of(s["order"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def outside(text: Column, spans: Column) -> Column:
    """The text with its spans overwritten by as many zeros, so that other places stay."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(state: Column, span: Column) -> Column:
        gap = F.greatest(span["start"] - state["at"], F.lit(0))
        over = F.greatest(span["end"] - F.greatest(span["start"], state["at"]), F.lit(0))
        more = F.array(text.substr(state["at"] + 1, gap), F.repeat(F.lit("0"), over))
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), F.concat(state["out"], more).alias("out"))

    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, cut, lambda s: F.concat(
        F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.length(text)))))


def terms_of(text: Column, spans: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.regexp_extract_all(outside(text, spans), F.lit(WORDS), F.lit(0)), F.lower))


def term_spans(text: Column, told: Column) -> Column:
    """Array of (start, order, end, share) of every occurrence of the terms in the map ``told``."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))
    pairs = F.arrays_zip(F.transform(F.split(text, WORDS), F.length).alias("gap"),
                         F.regexp_extract_all(text, F.lit(WORDS), F.lit(0)).alias("value"))

    def add(state: Column, pair: Column) -> Column:
        start = state["at"] + pair["gap"]
        end = start + F.length(pair["value"])
        share = F.try_element_at(told, F.lower(pair["value"]))
        one = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("order"), end.alias("end"), share.alias("share"))
        return F.when(pair["value"].isNull(), state).otherwise(F.struct(
            end.alias("at"), F.when(share.isNull(), state["out"]).otherwise(F.concat(state["out"], F.array(one))).alias("out")))

    return F.aggregate(pairs, empty, add, lambda s: s["out"])


def sent(few: DataFrame, size: Column) -> DataFrame:
    """``few``, written before, for a join: sent to all tasks if its rows, of ``size`` bytes, sum to ``MOST_SENT`` at most."""
    held = few.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(few) if held <= MOST_SENT else few


def repeated(rows: DataFrame) -> DataFrame:
    """``row, weight`` of one row of every repeated text: with 1 for all other rows the weights of a text sum to 1."""
    return rows.groupBy("hash").agg(F.min("row").alias("row"), F.count("*").alias("many")).where("many > 1").select(
        "row", (2 - F.col("many")).alias("weight"))


def disclosures(rows: DataFrame) -> DataFrame | None:
    """``value, term, share`` from ``GENERALISE`` on: the share of a value's information that a term gives away.

    Terms are counted over all rows in place, each with its row's weight, so that no text moves to be
    compared with its copies.
    """
    values = F.array_distinct(F.transform("spans", lambda s: s["value"]))
    held = cut_lineage(rows.where(F.size("spans") > 0).select("hash", "row", F.explode(values).alias("value")).groupBy(
        "value", "hash").agg(F.min("row").alias("row")))
    often = cut_lineage(held.groupBy("value").agg(F.count("*").alias("with_value")).where(F.col("with_value") >= SEEN))
    most = often.agg(F.max("with_value")).first()[0]
    if most is None:
        return None
    holders = cut_lineage(held.join(often, "value").select("row", "value", "with_value"))
    copies = cut_lineage(repeated(rows))
    n = F.lit(float(rows.count() - (copies.agg(F.sum(1 - F.col("weight"))).first()[0] or 0)))
    within = lambda with_value: (
        F.log("with_term") <= (1 - GENERALISE) * F.log(n) + GENERALISE * F.log(with_value) + 1e-9)
    words = terms_of(F.col("text"), F.col("spans")).alias("terms")
    weighed = rows.select("row", words).join(sent(copies, F.lit(16)), "row", "left")
    frequency = cut_lineage(
        weighed.select(F.explode("terms").alias("term"), F.coalesce("weight", F.lit(1)).alias("weight")).groupBy("term").agg(
            F.sum("weight").alias("with_term")).where((F.col("with_term") >= SEEN) & within(F.lit(most))))
    chosen = sent(cut_lineage(holders.select("row").distinct()), F.lit(8))
    told = rows.where(F.size("spans") > 0).join(chosen, "row", "left_semi").select(
        "row", F.explode(words).alias("term")).join(frequency, "term")
    pairs = told.join(holders, "row").where(within(F.col("with_value"))).groupBy(
        "value", "term", "with_value", "with_term").agg(F.count("*").alias("together")).where(F.col("together") >= SEEN)
    gain = F.log(F.col("together") * n / (F.col("with_value") * F.col("with_term")))
    own = F.log(n / F.col("with_value"))
    return pairs.select("value", "term", F.when(own > 0, gain / own).otherwise(F.lit(0.0)).alias("share")).where(
        F.col("share") >= GENERALISE)


def found_rows(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, text, hash, spans`` of all rows and ``told``, a map of the terms to hide to their share (or null)."""
    rows = df.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"),
                     F.monotonically_increasing_id().alias("row")).withColumns(
        {"hash": F.xxhash64("text"), "spans": base_spans(F.col("text"))})
    rows = cut_lineage(rows)
    found = disclosures(rows)
    if found is None:
        return rows.withColumn("told", F.lit(None).cast("map<string,double>"))
    told = sent(cut_lineage(found.groupBy("term").agg(F.max("share").alias("share"))), F.octet_length("term") + 16)
    hidden = cut_lineage(
        rows.select("row", F.explode(terms_of(F.col("text"), F.col("spans"))).alias("term")).join(told, "term").groupBy("row").agg(
            F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("told")))
    size = F.aggregate(F.map_keys("told"), F.lit(16), lambda total, term: total + F.octet_length(term) + 16)
    return rows.join(sent(hidden, size), "row", "left")


def replacement(span: Column) -> Column:
    by_kind = F.concat(F.lit("["), F.upper(kind_of(span["order"])), F.lit("]"))
    return F.when(span["share"] >= REMOVE, F.lit("")).when(span["share"].isNotNull(), F.lit("[WORD]")).otherwise(by_kind)


def sanitised(text: Column, spans: Column) -> Column:
    """The text with every span (start, order, end, share) replaced; of overlapping spans the union goes."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def cut(state: Column, span: Column) -> Column:
        gap = F.greatest(span["start"] - state["at"], F.lit(0))
        more = F.array(text.substr(state["at"] + 1, gap), F.when(span["start"] >= state["at"], replacement(span)).otherwise(""))
        return F.struct(F.greatest(span["end"], state["at"]).alias("at"), F.concat(state["out"], more).alias("out"))

    return F.aggregate(spans, start, cut, lambda s: F.concat(
        F.array_join(s["out"], ""), text.substr(s["at"] + 1, F.length(text))))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``base`` and ``spans`` (arrays by start, then kind) and ``clean_text`` (null: as it was)."""
    found = found_rows(df, doc_id, text)
    base = F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), F.lit(None).cast("double").alias("share")))
    terms = F.when(F.col("told").isNotNull(), term_spans(outside(F.col("text"), F.col("spans")), F.col("told"))).otherwise(
        F.array().cast(SPANS))
    both = found.withColumn("base", base.cast(SPANS)).withColumn("all", F.array_sort(F.concat("base", terms)))
    return both.select("doc_id", "base", F.col("all").alias("spans"),
                       F.when(F.size("all") > 0, sanitised(F.col("text"), F.col("all"))).alias("clean_text"))


def op7_privacy(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    orders = F.transform("base", lambda s: s["order"])
    counts = [F.size(F.filter(orders, lambda x, _: x == KINDS.index(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"),
                        F.sha2(F.col("clean_text").cast("binary"), 256).alias("clean_sha256"))
