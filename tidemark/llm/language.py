"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1-, 2- and 3-grams of the lower-cased text (what isn't a letter counts as one space) are
hashed to ``BUCKETS``. Document frequencies come from all training documents, summed per task before
they are shuffled. The classifier is fitted in one task on about ``SAMPLE`` training rows a language
(chosen by a hash) by follow-the-regularised-leader with L1 and L2 penalties; a fifth of them only set
the temperature that calibrates its probabilities. Every document is then scored from its whole text.

* Training rows are those with a language, text and doc_id whose fold (crc32 of doc_id mod 5) isn't 0.
  Null doc_ids are held out. Repeated rows count each time.
* Null texts, and texts without a letter, are ``und`` with score 0; so is every text if nothing can be
  learned (an empty table, no language known). Ties between languages go to the first by name.
* ``predict`` keeps no other columns than it is asked to; ``known_language`` keeps all.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, remainder, slices

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
SAMPLE = 1000
PASSES = 2
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.5
LETTER = regex.compile(r"\p{L}")
SURE = 0.3


def counts(text: str) -> np.ndarray:
    """How often each bucket's n-grams occur in the text."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where((codes < 128) & ((codes < 97) | (codes > 122)), np.uint32(32), codes)
    space = codes == 32
    codes = codes[np.r_[True, ~(space[1:] & space[:-1])]] if len(codes) else codes
    codes = np.r_[np.uint32(32), codes, np.uint32(32)].astype(np.uint32)
    two = codes[:-1] * np.uint32(0x9E3779B1) + codes[1:] * np.uint32(0x85EBCA77) + np.uint32(1)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + codes[2:] * np.uint32(0x27D4EB2F) + np.uint32(2)
    grams = np.concatenate([codes * np.uint32(0x165667B1), two, three])
    grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    return np.bincount(grams >> np.uint32(32 - BUCKET_BITS), minlength=BUCKETS)


def features(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and TF-IDF weights of a text, of length 1."""
    tf = counts(text)
    at = np.flatnonzero(tf)
    weight = np.log1p(tf[at]) * idf[at]
    return at, weight / max(np.sqrt(weight @ weight), 1e-12)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int) -> tuple[np.ndarray, float]:
    """Weights (buckets x classes) and temperature."""
    order = np.random.default_rng(7).permutation(len(rows))
    apart = set(order[:len(rows) // 5].tolist())
    z, n = np.zeros((BUCKETS, classes)), np.zeros((BUCKETS, classes))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, (np.sign(zs) * L1 - zs) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(PASSES):
        for i in order:
            if i not in apart:
                at, value, label = rows[i]
                w = weights(at)
                error = _softmax(value @ w)
                error[label] -= 1.0
                g = value[:, None] * error
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
                n[at] += g * g
    w = weights(slice(None))
    checked = [rows[i] for i in sorted(apart)] or rows
    logits = np.array([v @ w[at] for at, v, _ in checked])
    labels = np.array([label for *_, label in checked])
    losses = {t: -np.log(_softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean()
              for t in np.geomspace(0.05, 5.0, 60)}
    return w, float(min(losses, key=losses.get))


class Model:
    """Languages, inverse document frequencies, weights and temperature; a few MB whatever the corpus."""

    def __init__(self, languages: list[str], idf: np.ndarray, weights: np.ndarray, temperature: float):
        self.languages, self.idf, self.weights, self.temperature = languages, idf, weights, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        at, value = features(text, self.idf)
        p = _softmax(value @ self.weights[at] / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def _training(df: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    fold = remainder(doc_id, 5)
    return df.where((fold != 0) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("h"))


def train(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE) -> Model:
    rows = _training(df, doc_id, text, lang)

    def frequencies(batches):
        found, total = np.zeros(BUCKETS, np.int64), 0
        for batch in slices(batches, "text"):
            for t in batch.column("text").to_pylist():
                found[counts(t) > 0] += 1
            total += batch.num_rows
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[found[at], total])], ["bucket", "n"])

    held = rows.mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    by = dict(zip(held["bucket"], held["n"]))
    total = int(by.pop(-1, 0))
    frequency = np.zeros(BUCKETS)
    frequency[np.array(list(by), np.int64)] = list(by.values())
    idf = np.log((1 + total) / (1 + frequency)) + 1
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, sample / sizes[k])))[F.col("lang")]
    chosen = rows.where(F.pmod("h", F.lit(1_000_003)) / 1_000_003 < share)
    number = {k: i for i, k in enumerate(languages)}

    def extract(batches):
        for batch in slices(batches, "text"):
            made = [features(t, idf) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number[x] for x in batch.column("lang").to_pylist()], pa.int32()), batch.column("h"),
                 pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.float32()))],
                ["label", "h", "at", "value"])

    def learn(batches):
        got = []
        for b in batches:
            ends = b.column("at").offsets.to_numpy()
            at, value = b.column("at").values.to_numpy(), b.column("value").values.to_numpy()
            for i, (h, label) in enumerate(zip(b.column("h").to_pylist(), b.column("label").to_pylist())):
                got.append((h, label, at[ends[i]:ends[i + 1]], value[ends[i]:ends[i + 1]]))
        got.sort(key=lambda r: (r[0], r[1], len(r[2])))
        w, temperature = fit([(at, v, label) for _, label, at, v in got], len(languages))
        at, k = np.nonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[at, -1]), pa.array(np.r_[k, 0]), pa.array(np.r_[w[at, k], temperature])], ["bucket", "label", "w"])

    fitted = chosen.mapInArrow(extract, "label int, h long, at array<int>, value array<float>").repartition(1).mapInArrow(
        learn, "bucket long, label long, w double").toPandas()
    weights = np.zeros((BUCKETS, len(languages)))
    inner = fitted[fitted["bucket"] >= 0]
    weights[inner["bucket"], inner["label"]] = inner["w"]
    return Model(languages, idf, weights, float(fitted.loc[fitted["bucket"] < 0, "w"].iloc[0]))


def predict(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``keep`` columns with the predicted language and its calibrated probability."""
    rows = df.select(F.col(text).alias(free_name(df, "lid_text")), *keep)
    column = rows.columns[0]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[1:])

    def run(batches):
        for batch in slices(batches, column):
            made = [model.predict(t) for t in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())],
                [*batch.schema.names[1:], *names])

    return rows.mapInArrow(run, f"{schema}, `{names[0]}` string, `{names[1]}` double")


def known_language(df: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
                   sure: float = SURE) -> DataFrame:
    """The rows of ``df`` that are in a language: not ``und``, and no guess below ``sure``."""
    names = free_name(df, "lid_lang"), free_name(df, "lid_score")
    scored = predict(df, train(df, doc_id, text, lang), text, tuple(df.columns), names)
    return scored.where((F.col(names[0]) != "und") & (F.col(names[1]) >= sure)).select(df.columns)


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = train(docs)
    held = docs.withColumn("held_out", F.coalesce(remainder("doc_id", 5) == 0, F.lit(True)))
    return predict(held, model, keep=("doc_id", "held_out"))
