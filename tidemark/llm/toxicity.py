"""Toxicity by a weighted finite-state pattern grammar.

Five transducers read a clause word by word and are composed into one automaton: insults (words with
learned weights), threats, targets, negation and reported speech. Its state is what the clause has
said so far (a target, a negation within reach, a report); an insult's weight is raised when the
clause has a target or a threat and lowered when it is negated or reported. A threat that is not negated scores
``THREAT`` with a target even without an insult, and such clauses are a feature of their own. What counts is the matched clause,
not the bare word. Clause scores become a probability by a small logistic regression.

Insult weights are lower bounds of log-odds from the words of all training documents, summed per task before they are
shuffled. Up to ``MOST_WORDS`` of them are sent to every task, a larger table is joined to each document's words. The regression is fitted on the clause features of about ``SAMPLE`` training rows, half of each label, or
all rows of a label that has fewer; its intercept is then moved to the base rate.

* Training rows have a label, a doc_id and a fold (crc32 of doc_id mod 3) other than 1. Labels, lang,
  source and doc_id are no inputs of a score. Null doc_ids are held out; repeated labels: the larger holds.
* Null and empty texts have no matches and get the score of such texts. Without rows of both labels every score is 0.
* Texts are read whole; other columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, remainder, slices, text_of
from tidemark.session import cut_lineage

SAMPLE = 20_000
#: An insult is in this many toxic documents at least, however large the corpus.
LEAST = 3
#: As many insults are sent to every task; more are joined to the words of each document.
MOST_WORDS = 200_000
#: Lower bound of the log-odds from which a word counts, and the standard errors below the estimate.
ODDS, Z = 2.0, 1.28
FLUSH = 200_000

TARGETS = frozenset("you your yours yourself he she they them him her these those people everyone du dich dir ihr euch tu te toi vous tú ti usted ustedes él ella ellos".split())
NEGATIONS = frozenset("not never no isn't aren't wasn't don't nobody without nicht kein keine nie pas jamais aucun ni nunca sin".split())
REPORTS = frozenset("said says called calls claimed wrote quoted reported allegedly sagte nannte schrieb dit appelé écrit dijo llamó escribió".split())
THREATS = frozenset("kill hurt destroy beat burn shoot stab attack punch die töten schlagen tuer frapper matar golpear".split())

CLAUSE = re.compile(r"[^.!?;:,\n]+")
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
#: Words over which a negation reaches.
REACH = 3
RAISED, LOWERED, QUOTED, THREAT = 1.5, 0.5, 0.6, 2.0


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Grammar:
    """The composed automaton over the classes of words."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.marks = {}
        for name, words in (("target", TARGETS), ("negation", NEGATIONS), ("report", REPORTS), ("threat", THREATS)):
            for w in words:
                self.marks.setdefault(w, set()).add(name)

    def clause(self, words: list[str]) -> float:
        """The weight of one clause's path."""
        return self.path(words)[0]

    def path(self, words: list[str]) -> tuple[float, bool]:
        """The weight of one clause's path, and whether it threatens a target."""
        target = report = threat = False
        negated, sure, doubted = 0, 0.0, 0.0
        for w in words:
            marks = self.marks.get(w, ())
            target |= "target" in marks
            report |= "report" in marks
            weight = self.insults.get(w, 0.0)
            if "threat" in marks:
                threat = threat or not negated
            if weight:
                if negated:
                    doubted += weight
                else:
                    sure += weight
            negated = REACH if "negation" in marks else max(0, negated - 1)
        score = (sure + LOWERED * doubted) * (RAISED if target else 1.0)
        if threat and target:
            score += THREAT
        return score * (QUOTED if report else 1.0), threat and target

    def features(self, text: str) -> list[float]:
        """Strongest clause, sum over clauses, number of matched clauses, each on a log scale."""
        return self.inputs(text)[:3]

    def inputs(self, text: str) -> list[float]:
        """The ``features`` and the number of clauses that threaten a target, on a log scale."""
        text = text.lower()
        words = TOKEN.findall(text)
        if self.insults.keys().isdisjoint(words) and THREATS.isdisjoint(words):
            return [0.0] * 4
        paths = [p for c in CLAUSE.findall(text) if (p := self.path(TOKEN.findall(c)))[0] > 0]
        if not paths:
            return [0.0] * 4
        scores = [s for s, _ in paths]
        return [math.log1p(x) for x in (max(scores), sum(scores), len(scores), sum(t for _, t in paths))]


def _marks(labels: DataFrame, label: str) -> DataFrame:
    """``tox_id, tox_label, h`` of the documents that may be learned from."""
    marked = labels.where(F.col(label).isNotNull() & (remainder("doc_id", 3) != 1))
    return marked.groupBy(F.col("doc_id").alias("tox_id")).agg(F.max(label).alias("tox_label")).withColumn("h", F.xxhash64("tox_id"))


def insults(rows: DataFrame) -> DataFrame | None:
    """``word, odds``: words much likelier in toxic documents, with the lower bound of their log-odds."""
    def count(batches):
        found: list[Counter] = [Counter(), Counter()]
        docs = [0, 0]

        def flush():
            words = [*found[1].keys() | found[0].keys()]
            out = pa.RecordBatch.from_arrays(
                [pa.array(words + [""], pa.string()),
                 pa.array([found[1][w] for w in words] + [docs[1]], pa.int64()),
                 pa.array([found[0][w] for w in words] + [docs[0]], pa.int64())], ["word", "toxic", "clean"])
            found[0].clear()
            found[1].clear()
            docs[:] = [0, 0]
            return out

        for batch in slices(batches, "text"):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("tox_label").to_pylist()):
                found[y > 0].update(set(tokens(t)))
                docs[y > 0] += 1
            if len(found[0]) + len(found[1]) > FLUSH:
                yield flush()
        yield flush()

    sums = cut_lineage(rows.mapInArrow(count, "word string, toxic long, clean long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    total = sums.where("word = ''").first()
    if not total or not total["toxic"]:
        return None
    n, m = total["toxic"], total["clean"]
    more, less = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(more / F.lit(n + 1.0)) - F.log(less / F.lit(m + 1.0)) - Z * F.sqrt(1 / more + 1 / less)
    kept = sums.where((F.col("word") != "") & (F.col("toxic") >= LEAST) & (odds >= ODDS))
    return cut_lineage(kept.select("word", odds.alias("odds")))


def with_words(rows: DataFrame, table: DataFrame, text: str) -> DataFrame:
    """``rows`` and ``tox_words``: the insults of each text with their weights, by a join."""
    numbered = cut_lineage(rows.withColumn("tox_row", F.monotonically_increasing_id()))

    def emit(batches):
        for batch in slices(batches, text):
            for row, t in zip(batch.column("tox_row").to_pylist(), batch.column(text).to_pylist()):
                words = [*set(tokens(t or ""))]
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(words), pa.int64()), pa.array(words, pa.string())], ["tox_row", "word"])

    held = numbered.select("tox_row", text).mapInArrow(emit, "tox_row long, word string").join(table, "word")
    maps = held.groupBy("tox_row").agg(F.map_from_entries(F.collect_list(F.struct("word", "odds"))).alias("tox_words"))
    return numbered.join(maps, "tox_row", "left").drop("tox_row")


def fit(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) / len(y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x / len(y) + penalty * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


class Model:
    """``table`` holds the insults that are too many for the grammar."""

    def __init__(self, grammar: Grammar, weights: np.ndarray | None, table: DataFrame | None = None):
        self.grammar, self.weights, self.table = grammar, weights, table

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return 0.0
        x = self.grammar.inputs(text or "") + [1.0]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.weights @ x)))))


def each_text(batch: pa.RecordBatch, text: str, grammar: Grammar) -> Iterator[str | None]:
    """The batch's texts; where ``tox_words`` came with them the grammar knows those of the text at hand."""
    own = batch.column("tox_words").to_pylist() if "tox_words" in batch.schema.names else None
    for i, t in enumerate(batch.column(text).to_pylist()):
        if own is not None:
            grammar.insults = dict(own[i] or ())
        yield t


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    marks = _marks(labels, label)
    # Labels grow with the corpus, so they are never sent to all tasks: whole texts are dealt by doc_id, once.
    dealt = marks.hint("shuffle_merge")
    texts = docs.where(remainder("doc_id", 3) != 1).select(F.col("doc_id").alias("id"), text_of().alias("text"))
    rows = texts.join(dealt, F.col("id") == F.col("tox_id")).select("text", "tox_label")
    table = insults(rows)
    many = table is not None and table.count() > MOST_WORDS
    grammar = Grammar({} if many or table is None else {r["word"]: r["odds"] for r in table.collect()})
    table = table if many else None

    def extract(batches):
        for batch in slices(batches, "text"):
            made = [grammar.inputs(t) for t in each_text(batch, "text", grammar)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.list_(pa.float64())), batch.column("tox_label").cast(pa.int32())], ["x", "y"])

    marked = F.col("tox_label") > 0
    known = texts.select("id").join(dealt, F.col("id") == F.col("tox_id"))
    counts = {r["y"]: r["count"] for r in known.groupBy(marked.alias("y")).count().collect()}
    share = F.when(marked, sample / 2 / max(counts.get(True, 0), 1)).otherwise(sample / 2 / max(counts.get(False, 0), 1))
    # About ``sample`` documents are drawn by their ids alone; so few ids are sent to the texts.
    drawn = known.where(F.pmod("h", F.lit(1_000_000_007)) / 1_000_000_007 < share).select("tox_id", "tox_label").distinct()
    chosen = texts.join(F.broadcast(drawn), F.col("id") == F.col("tox_id")).select("text", "tox_label")
    got = (chosen if table is None else with_words(chosen, table, "text")).mapInArrow(extract, "x array<double>, y int").toPandas()
    y = (got["y"] > 0).to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(grammar, None)
    weights = fit(np.array(got["x"].tolist()), y)
    weights[-1] += math.log(counts[True] / counts[False]) - math.log(y.sum() / (len(y) - y.sum()))
    return Model(grammar, weights, table)


def scored(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``score`` (``score_`` beside a kept column of that name)."""
    own, kept = df.select(*keep), [f"kept_{i}" for i in range(len(keep))]
    rows = df.select(F.col(text).alias("tox_text"), *[F.col(c).alias(k) for c, k in zip(keep, kept)])
    names = [*own.columns, free_name(own, "score")]
    schema = ", ".join(f"`{c}` {k}" for c, k in zip(names, [*(f.dataType.simpleString() for f in own.schema), "double"]))
    sent = Model(model.grammar, model.weights)  # without the table
    if model.table is not None:
        rows = with_words(rows, model.table, "tox_text")

    def run(batches):
        for batch in slices(batches, "tox_text"):
            made = [sent.score(t) for t in each_text(batch, "tox_text", sent.grammar)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), pa.array(made, pa.float64())], names)

    return rows.mapInArrow(run, schema)


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))
    held = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 3) == 1, F.lit(True)))
    return scored(held, model, keep=("doc_id", "held_out")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))
