"""Phrase collocations: HAT-tries of word windows per task, sorted runs merged per prefix partition.

Every position of a piece is a window of up to four words. A task counts its windows in a shallow trie
over word ids whose leaves are hash containers: a first word starts with one container, which bursts
into one per second word when it grows past ``BURST`` entries. A task that holds ``HOLD`` windows spills
its largest subtrees whole, as sorted runs cut by prefix partition; Spark shuffles the runs, and each
partition merges its own into exact counts of all its phrases. Single words go the same way.

A prefix partition is a hash of a window's first two words and holds about ``PART`` bytes of text. Where
a bounded sample of documents shows a prefix that would outgrow it, its windows are cut by the third
word as well (and the fourth), and the partial sums of the prefix are added at the end. The sample only
places work; counts are of all windows.

* Null and empty texts have no words. Null languages read as ``und``. Repeated rows count again; other
  columns are ignored. Empty tables give empty results. Ids are not looked at.
* A long text is cut into words a stretch at a time; its windows are those of the whole text.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import documents, slices
from tidemark.operators.prefix import latest_n
from tidemark.session import cut_lineage

LONGEST = 4
LEAST = 30
FIRST = 2000
COVER = 80
SCALE = 2_000_000
#: Containers, spills and partitions: entries, windows, bytes of text.
BURST = 1 << 14
HOLD = 400_000
PART = 1 << 24
#: Bytes of text that the search for heavy prefixes reads, and prefixes that it names at most.
SAMPLE = 1 << 23
HEAVY = 4096

# A-Z in lower case, tab as space, what ends a piece as line feed.
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_BITS = 21  # of a word id within a task
_MASK = (1 << _BITS) - 1
_PAD, _EMPTY = 0, 1  # ids of a piece's end and of nothing
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


class Words(dict):
    """Word (UTF-8) to id, in order of appearance."""

    def __init__(self):
        super().__init__({b"\n": _PAD, b"": _EMPTY})

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self)
        return found

    def of(self, text: bytes, stretch: int = 1 << 20) -> np.ndarray:
        """The ids of a text's words in order, ``_PAD`` after each piece."""
        plain, out, start = text.translate(_PLAIN), [], 0
        while start < len(plain):
            end = start + stretch
            if end < len(plain):
                cuts = [x for x in (plain.find(b" ", end), plain.find(b"\n", end)) if x >= 0]
                end = min(cuts, default=len(plain))
            cut = plain[start:end].replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(self.__getitem__, cut), np.int32, len(cut))
            out.append(ids[ids != _EMPTY])
            start = end
        return np.concatenate([*out, np.zeros(1, np.int32)])


def windows(ids: np.ndarray) -> np.ndarray:
    """The words at each word's place and the three after it, ``_PAD`` from the piece's end on."""
    ahead = np.concatenate([ids, np.zeros(LONGEST, np.int32)])
    out = np.empty((len(ids), LONGEST), np.int32)
    out[:, 0] = ids
    for k in range(1, LONGEST):
        out[:, k] = np.where(out[:, k - 1] == _PAD, _PAD, ahead[k:k + len(ids)])
    return out[out[:, 0] != _PAD]


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a run of equal rows begins."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


class HatTrie:
    """Window counts under word ids: ``{first: container}``, a burst one ``{first: {second: container}}``.

    A container maps the packed rest of a window to its count.
    """

    def __init__(self, burst: int = BURST):
        self.burst, self.held = burst, 0
        self.small: dict[int, dict[int, int]] = {}
        self.split: dict[int, dict[int, dict[int, int]]] = {}

    def add(self, rows: np.ndarray) -> None:
        """Count the rows of ``windows`` that have a second word."""
        first, second, low = rows[:, 0], rows[:, 1], rows[:, 2].astype(np.int64) << _BITS | rows[:, 3]
        order = np.argsort(first.astype(np.int64) << _BITS | second)
        first, second, low = first[order], second[order], low[order]
        keys, lows = (second.astype(np.int64) << 2 * _BITS | low).tolist(), low.tolist()
        cuts = np.r_[_starts(first), len(first)].tolist()
        small, split, grown = self.small, self.split, 0
        for w, a, b in zip(first[cuts[:-1]].tolist() if keys else [], cuts, cuts[1:]):
            if w in split:
                node = split[w]
                inner = [a + x for x in _starts(second[a:b]).tolist()] + [b]
                for v, c, d in zip(second[inner[:-1]].tolist(), inner, inner[1:]):
                    leaf = node.get(v)
                    if leaf is None:
                        leaf = node[v] = {}
                    grown -= len(leaf)
                    for key in lows[c:d]:
                        leaf[key] = leaf.get(key, 0) + 1
                    grown += len(leaf)
                continue
            leaf = small.get(w)
            if leaf is None:
                leaf = small[w] = {}
            grown -= len(leaf)
            for key in keys[a:b]:
                leaf[key] = leaf.get(key, 0) + 1
            grown += len(leaf)
            if len(leaf) > self.burst:
                node = split[w] = {}
                for key, n in small.pop(w).items():
                    node.setdefault(key >> 2 * _BITS, {})[key & ((1 << 2 * _BITS) - 1)] = n
        self.held += grown

    def spill(self, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Take whole subtrees out, the largest first, until ``keep`` windows are left: rows and counts."""
        sizes = {w: len(leaf) for w, leaf in self.small.items()}
        sizes |= {w: sum(map(len, node.values())) for w, node in self.split.items()}
        firsts, seconds, leaves = [], [], []
        for w in sorted(sizes, key=sizes.get, reverse=True):
            if self.held <= keep:
                break
            node = {-1: self.small.pop(w)} if w in self.small else self.split.pop(w)
            firsts += [w] * len(node)
            seconds += node
            leaves += node.values()
            self.held -= sizes[w]
        held = list(map(len, leaves))
        packed = np.fromiter(chain.from_iterable(leaves), np.int64, sum(held))
        second = np.repeat(np.array(seconds, np.int64), held)
        rows = np.empty((len(packed), LONGEST), np.int32)
        rows[:, 0], rows[:, 1] = np.repeat(np.array(firsts, np.int32), held), np.where(second < 0, packed >> 2 * _BITS, second)
        rows[:, 2], rows[:, 3] = packed >> _BITS & _MASK, packed & _MASK
        return rows, np.fromiter(chain.from_iterable(map(dict.values, leaves)), np.int64, len(packed))


def _mix(value: np.ndarray) -> np.ndarray:
    value = (value ^ (value >> np.uint64(31))) * _ODD[3]
    return value ^ (value >> np.uint64(29))


def prefix_hashes(lang: str, hashes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
    """A hash of each row's first 1, 2, 3 and 4 words; ``hashes`` are those of the words by id."""
    state = np.full(len(rows), xxhash.xxh64_intdigest(lang.encode()), np.uint64)
    out = []
    for k in range(LONGEST):
        state = _mix(state * _ODD[k % 3] + hashes[rows[:, k]])
        out.append(state)
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))


def _part_of(prefixes: list[np.ndarray], parts: int, heavy: np.ndarray) -> np.ndarray:
    """The prefix partition: of two words, or of as many as it takes to leave the heavy prefixes."""
    chosen = prefixes[1]
    for k in range(2, LONGEST):
        chosen = np.where(np.isin(chosen, heavy) & (chosen == prefixes[k - 1]), prefixes[k], chosen)
    return chosen % np.uint64(parts)


class Sorted:
    """Words in byte order, one after another as bytes; number 0 is none."""

    def __init__(self, words: list[bytes]):
        self.ends = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)  # a line feed after each
        self.body = np.frombuffer(b"\n".join([*words, b""]), np.uint8)

    def text(self, numbers: np.ndarray) -> bytes:
        """The words of the given numbers (from 1), a line feed after each."""
        start = self.ends[numbers - 1]
        size = self.ends[numbers] - start
        shift = start - (np.cumsum(size) - size)
        return self.body[np.repeat(shift, size) + np.arange(size.sum())].tobytes()


def pack_run(words: Sorted, rows: np.ndarray, counts: np.ndarray) -> bytes:
    """A sorted run: the words it uses, its rows as ranks among them, its counts."""
    used = np.zeros(len(words.ends), bool)
    used[rows.ravel()] = True
    used[0] = False
    some = np.flatnonzero(used)
    rank = np.zeros(len(used), np.int64)
    rank[some] = np.arange(1, len(some) + 1)
    ranked = rank[rows]
    order = np.lexsort((ranked[:, 2] << 31 | ranked[:, 3], ranked[:, 0] << 31 | ranked[:, 1]))
    kind = np.uint16 if len(some) < 1 << 16 else np.uint32
    many = np.flatnonzero(counts[order] != 1)
    text = words.text(some)
    head = np.array([len(rows), kind().itemsize, len(many), len(text)], np.int64).tobytes()
    body = head + text + ranked[order].astype(kind).T.tobytes() + many.tobytes() + counts[order][many].tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def read_run(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words by rank (from 1), rows, counts."""
    body = zstandard.ZstdDecompressor().decompress(data)
    n, width, many, size = np.frombuffer(body, np.int64, 4).tolist()
    at = 32 + size
    words = [b"", *body[32:at].split(b"\n")[:-1]]
    rows = np.frombuffer(body, f"u{width}", n * LONGEST, at).reshape(LONGEST, n).T.astype(np.int64)
    at += n * LONGEST * width
    counts = np.ones(n, np.int64)
    counts[np.frombuffer(body, np.int64, many, at)] = np.frombuffer(body, np.int64, many, at + 8 * many)
    return words, rows, counts


class _Task:
    """What one task counts: a trie and single words per language, one numbering of words."""

    def __init__(self, parts: int, heavy: np.ndarray, hold: int, burst: int):
        self.parts, self.heavy, self.hold, self.burst = parts, heavy, hold, burst
        self.begin()

    def begin(self) -> None:
        self.words, self.tries, self.single = Words(), {}, {}
        self.hashes = np.zeros(0, np.uint64)
        self.waiting, self.tokens = {}, 0

    def read(self, lang: str, text: bytes) -> None:
        ids = self.words.of(text)
        self.waiting.setdefault(lang, []).append(ids)
        self.tokens += len(ids)

    def count(self, step: int = 1 << 18) -> None:
        for lang, held in self.waiting.items():
            ids = np.concatenate(held)
            sums = np.bincount(ids, minlength=len(self.words))
            before = self.single.get(lang, np.zeros(0, np.int64))
            sums[:len(before)] += before
            self.single[lang] = sums
            trie = self.tries.setdefault(lang, HatTrie(self.burst))
            for i in range(0, len(ids), step):
                rows = windows(ids[i:i + step + LONGEST - 1])
                here = np.count_nonzero(ids[i:i + step])  # the places that this step owns
                rows = rows[:here]
                trie.add(rows[rows[:, 1] != _PAD])
                yield from self.spilled(self.hold)
        self.waiting, self.tokens = {}, 0
        if len(self.words) > _MASK // 2:
            yield from self.end()

    def spilled(self, most: int):
        held = sum(t.held for t in self.tries.values())
        if held > most:
            yield from self.runs({lang: t.spill(t.held * most // (2 * held)) for lang, t in self.tries.items()})

    def runs(self, found: dict[str, tuple[np.ndarray, np.ndarray]]):
        """Rows and counts by language as sorted runs, one for each prefix partition."""
        names = list(self.words)
        self.hashes = np.r_[self.hashes, _word_hashes(names[len(self.hashes):])]
        used = np.zeros(len(names), bool)
        for rows, _ in found.values():
            used[rows.ravel()] = True
        order = [_PAD, *sorted((np.flatnonzero(used[_EMPTY + 1:]) + _EMPTY + 1).tolist(), key=names.__getitem__)]
        rank = np.zeros(len(names), np.int32)
        rank[order] = np.arange(len(order))  # the words in byte order
        words, hashes = Sorted([names[i] for i in order[1:]]), self.hashes[order]
        for lang, (rows, counts) in found.items():
            rows = rank[rows]
            prefixes = prefix_hashes(lang, hashes, rows)
            part = np.where(rows[:, 1] == _PAD, prefixes[0] % np.uint64(self.parts), _part_of(prefixes, self.parts, self.heavy))
            order = np.argsort(part, kind="stable")
            cuts = np.r_[_starts(part[order]), len(order)].tolist() if len(order) else []
            for a, b in zip(cuts, cuts[1:]):
                here = order[a:b]
                yield int(part[here[0]]), lang, pack_run(words, rows[here], counts[here])

    def end(self):
        found = {}
        for lang, sums in self.single.items():
            sums[:_EMPTY + 1] = 0
            some = np.flatnonzero(sums)
            alone = np.zeros((len(some), LONGEST), np.int32)
            alone[:, 0] = some
            rows, counts = self.tries[lang].spill(0)
            found[lang] = np.concatenate([rows, alone]), np.concatenate([counts, sums[some]])
        yield from self.runs(found)
        self.begin()


class _Merge:
    """The runs of one prefix partition and language, merged in numbers of its own."""

    def __init__(self):
        self.words, self.sums, self.waiting, self.held = Words(), None, [], 0

    def take(self, data: bytes, most: int = 1 << 21) -> None:
        words, rows, counts = read_run(data)
        number = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        number[0] = _PAD
        rows = number[rows]
        self.waiting.append((rows[:, 0] << 31 | rows[:, 1], rows[:, 2] << 31 | rows[:, 3], counts))
        self.held += len(rows)
        if self.held > max(most, 0 if self.sums is None else len(self.sums[0])):
            self.settle()

    def settle(self) -> None:
        every = [*([self.sums] if self.sums else []), *self.waiting]
        high, low, counts = (np.concatenate([x[i] for x in every]) for i in range(3))
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        at = _starts(high, low)
        self.sums = high[at], low[at], np.add.reduceat(counts[order], at)
        self.waiting, self.held = [], 0

    def phrases(self, lang: str, least: int, heavy: np.ndarray):
        """Phrase, its words, its count: those of ``least`` and more, partial ones all; the total under null."""
        self.settle()
        names, mask = list(self.words), (1 << 31) - 1
        high, low, counts = self.sums
        rows = np.stack([high >> 31, high & mask, low >> 31, low & mask], axis=1)
        alone = rows[:, 1] == _PAD
        out = [(None, 0, int(counts[alone].sum()))]
        out += [(names[w], 1, n) for w, n in zip(rows[alone, 0].tolist(), counts[alone].tolist()) if n >= least]
        rows, counts = rows[~alone], counts[~alone]
        hashes = _word_hashes(names) if len(heavy) and len(rows) else None
        for k in range(2, LONGEST + 1):
            if not len(rows):
                break
            at = _starts(*rows.T[:k])
            some, sums = rows[at], np.add.reduceat(counts, at)
            good = sums >= least
            if hashes is not None and k < LONGEST:
                good |= np.isin(prefix_hashes(lang, hashes, some)[k - 1], heavy)
            good &= some[:, k - 1] != _PAD
            out += [(b" ".join(names[w] for w in r), k, n) for r, n in zip(some[good, :k].tolist(), sums[good].tolist())]
        return out


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))


def heavy_prefixes(texts: DataFrame, size: int, part: int) -> np.ndarray:
    """Hashes of prefixes of two and three words whose windows would fill a partition, by a bounded sample."""
    def run(batches):
        for batch in slices(batches, "text"):
            words, by = Words(), {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by.setdefault(lang, []).append(words.of(text))
            hashes = _word_hashes(list(words))
            for lang, ids in by.items():
                rows = windows(np.concatenate(ids))
                prefixes = prefix_hashes(lang, hashes, rows)
                for k in (1, 2):
                    found, n = np.unique(prefixes[k][rows[:, k] != _PAD], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], ["prefix", "n"])

    share = min(1.0, SAMPLE / max(size, 1))
    sums = texts.sample(share, seed=13).mapInArrow(run, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))
    # About six bytes make a window; half a partition leaves room for what else falls into it.
    most = max(1.0, share * part / 6 / 2)
    found = sums.where(F.col("n") > most).orderBy(F.desc("n"), "prefix").limit(HEAVY).collect()
    return np.array([r["prefix"] for r in found], np.int64).view(np.uint64)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, part: int = PART,
                  hold: int = HOLD, burst: int = BURST) -> DataFrame:
    """``lang, phrase, k, a``: every phrase of 1 to 4 words with a >= ``least``, and per language, with
    null phrase and k = 0, the number of its words."""
    texts = _texts(docs, text, lang)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    parts = max(1, -(-size // part))
    heavy = heavy_prefixes(texts, size, part) if parts > 1 else np.zeros(0, np.uint64)

    def count(batches):
        task, out, held = _Task(parts, heavy, hold, burst), [], 0

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array(
                [x[1] for x in found], pa.string()), pa.array([x[2] for x in found], pa.binary())], ["part", "lang", "run"])

        def send(runs):
            nonlocal out, held
            for x in runs:
                out.append(x)
                held += len(x[2])
                if held > 1 << 22:
                    yield rows(out)
                    out, held = [], 0

        for batch in slices(batches, "text"):
            for name, body in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                task.read(name, body)
                if task.tokens > 1 << 20:
                    yield from send(task.count())
        yield from send(task.count())
        yield from send(task.end())
        if out:
            yield rows(out)

    def merge(batches):
        at, merger = None, None

        def finish():
            found = merger.phrases(at[1], least, heavy)
            return pa.RecordBatch.from_arrays(
                [pa.array([at[1]] * len(found), pa.string()),
                 pa.array([None if p is None else p.decode() for p, _, _ in found], pa.string()),
                 pa.array([k for _, k, _ in found], pa.int32()), pa.array([n for *_, n in found], pa.int64())],
                ["lang", "phrase", "k", "a"])

        for batch in batches:
            for part, name, run in zip(*(batch.column(i) for i in range(3))):
                key = part.as_py(), name.as_py()
                if key != at:
                    if merger:
                        yield finish()
                    at, merger = key, _Merge()
                merger.take(run.as_py())
        if merger:
            yield finish()

    runs = texts.mapInArrow(count, "part long, lang string, run binary")
    dealt = runs.repartition(min(parts, 1 << 15), "part").sortWithinPartitions("part", "lang")
    found = dealt.mapInArrow(merge, "lang string, phrase string, k int, a long")
    return found.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where((F.col("k") == 0) | (F.col("a") >= least))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, cover: int = COVER,
                 first: int | None = FIRST, **memory: int) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's phrases by how firmly their words hold together.

    The score of a cut is floor(2000000 * a / (l + r)), in whole numbers of 38 digits; the lowest-scoring
    cut counts, of equal ones the earliest. A phrase goes where a longer one takes up ``cover`` percent of
    its occurrences.
    """
    counts = cut_lineage(phrase_counts(docs, text, lang, least, **memory))
    known, totals = counts.where("k > 0"), counts.where("k = 0").select("lang", F.col("a").alias("n"))
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    whole = known.where("k > 1").select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))

    def part(start, length):
        return F.array_join(F.slice("w", start, length), " ")

    cuts = whole.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"),
                       part(F.col("cut") + 1, F.size("w")).alias("right"))
    of = lambda name, n: known.select(
        "lang", F.col("phrase").alias(name), F.col("a").alias(n))
    cuts = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    cuts = cuts.withColumn("_over", wide("a") * F.lit(SCALE)).withColumn("_under", wide("l") + wide("r"))
    cuts = cuts.withColumn("score", F.expr("cast(_over as decimal(38,0)) div cast(_under as decimal(38,0))").cast("long"))
    lowest = cuts.groupBy("lang", "phrase", "a").agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("best")).select("lang", "phrase", "a", "best.*")

    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.size("w") - 1), lambda n: F.transform(
            F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " ")))))
    longer = (whole.where(F.size("w") > 2).select("lang", F.col("a").alias("f"), inner.alias("phrase"))
              .groupBy("lang", "phrase").agg(F.max("f").alias("f")))
    kept = lowest.join(longer, ["lang", "phrase"], "left").where(
        F.col("f").isNull() | (wide("f") * 100 < wide("a") * cover)).drop("f", "cut")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    if first is not None:
        kept = latest_n(kept, ["lang"], order, first, ["phrase"])
    ranked = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(documents(spark, sf_dir))


SQL = f"""WITH d AS (SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT d, lang, unnest(x) AS p, generate_subscripts(x, 1) AS i FROM (
  SELECT d, lang, regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]') AS x FROM d)),
w AS (SELECT d, i, lang, unnest(x) AS w, generate_subscripts(x, 1) AS j FROM (
  SELECT d, i, lang, list_filter(regexp_split_to_array(p, '[\\x20\\x09]+'), lambda s: s <> '') AS x FROM p)),
g AS (SELECT lang, w, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
  FROM w WINDOW o AS (PARTITION BY d, i ORDER BY j)),
f AS (SELECT lang, [w] AS x, count(*) AS a FROM g GROUP BY lang, w
  UNION ALL SELECT lang, [w, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY lang, w, w2 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY lang, w, w2, w3 HAVING count(*) >= {LEAST}
  UNION ALL SELECT lang, [w, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL
    GROUP BY lang, w, w2, w3, w4 HAVING count(*) >= {LEAST}),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
c AS (SELECT lang, x, a, unnest(range(1, len(x))) AS k FROM f WHERE len(x) > 1),
s AS (SELECT c.lang, c.x, c.a, c.k, b.a AS l, e.a AS r, ({SCALE}::HUGEINT * c.a) // (b.a + e.a)::HUGEINT AS score
  FROM c JOIN f b ON b.lang = c.lang AND b.x = c.x[:c.k] JOIN f e ON e.lang = c.lang AND e.x = c.x[c.k + 1:]),
q AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, x ORDER BY score, k) = 1),
u AS (SELECT lang, x[i:i + m - 1] AS x, max(a) AS f FROM (
  SELECT lang, x, a, m, unnest(range(1, len(x) - m + 2)) AS i FROM (
    SELECT lang, x, a, unnest(range(2, len(x))) AS m FROM f WHERE len(x) > 2)) GROUP BY ALL),
z AS (SELECT q.lang, array_to_string(q.x, ' ') AS phrase, q.a, l, r, n, score::BIGINT AS score
  FROM q JOIN n ON n.lang = q.lang LEFT JOIN u ON u.lang = q.lang AND u.x = q.x
  WHERE u.f IS NULL OR 100 * u.f < {COVER} * q.a)
SELECT lang, row_number() OVER v AS rank, phrase, a, l, r, n, score FROM z
WINDOW v AS (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) QUALIFY row_number() OVER v <= {FIRST}"""
