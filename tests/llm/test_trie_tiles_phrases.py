"""Conversation prefixes, similar vectors and phrases, each against a plain version of itself."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm import data
from tidemark.llm import bpe, collocations, language, prefixes, queries, similar, topk, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.VOCABULARY)


# --- conversation prefixes ---

TALKS = "conv_id long, turn long, role string, text string, id string, size long, shard int"


def talks(seed=5, n=130):
    draw = random.Random(seed)
    out = []
    for c in [*range(-12, n), 1000, 1001, 1007, 10**12 + 3]:
        for t in range(draw.choice([0, 1, 2, 3, 9, 12])):
            hot = t < 4 and draw.random() < 0.7
            out.append((c, t, draw.choice(["user", "user", None]), "hot" if hot else draw.choice(["ü", "", None, f"t{draw.randint(0, 4)}"])))
    out += [(500, t, "user", f"long {t % 70}") for t in range(150)] + [(501, t, "user", f"long {t % 70}") for t in range(90)]
    out += [(502, None, "a", "first"), (502, 0, None, None), (502, 0, None, None), (None, 0, "user", "nobody"), (3, 5, "x", "y" * 100_000)]
    return [(*r, "clash", 1, 2) for r in out]


def plain_trie(rows, rebuild=True):
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256((str(len(role.encode())) + ":" + role + text).encode()).hexdigest()[:32]
            own[c].append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(ts, key=lambda x: x[0])] for c, ts in own.items()}
    made = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 9, c - int(np.fmod(c, 5))
        made[c] = tuple(own.get(base, [])[:h] + turns[h:]) if rebuild else tuple(turns)
    members = defaultdict(list)
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, cs in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(cs) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in sorted(cs) if len(made[c]) == len(p)).encode()).hexdigest()) for p, cs in members.items())


@pytest.mark.parametrize("shard_turns", [7, 60, 1 << 18])
def test_prefixes_are_those_of_a_plain_trie(spark, shard_turns):
    rows = spark.createDataFrame(talks(), TALKS).repartition(3)
    turns = prefixes.turn_ids(rows, "conv_id", "turn", "role", "text")
    got = prefixes.prefix_trie(prefixes.rebuilt(turns), shard_turns, 1).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(plain_trie(talks()), key=lambda r: r[:2])


def test_a_node_that_ends_in_many_shards(spark):
    rows = [(c, t, "user", "same") for c in range(3000) for t in range(1 + c % 2)] + [(c, 0, "user", f"own {c}") for c in range(3000, 3010)]
    turns = prefixes.turn_ids(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), "conv_id", "turn", "role", "text")
    got = prefixes.prefix_trie(prefixes.sequences(turns), 200, 1).collect()
    assert sorted(map(tuple, got), key=lambda r: r[:2]) == sorted(plain_trie(rows, False), key=lambda r: r[:2])


def test_no_conversations_no_root(spark):
    rows = spark.createDataFrame([], TALKS)
    assert not prefixes.prefix_trie(prefixes.rebuilt(prefixes.turn_ids(rows, "conv_id", "turn", "role", "text"))).collect()


# --- similar vectors ---

VECTORS = "vec_id long, embedding array<float>, label int, row long, key string, n long"


def vectors(seed=4, dim=12):
    draw = np.random.default_rng(seed)
    out = [(i, draw.normal(size=dim).tolist()) for i in range(150)]
    centre = draw.normal(size=dim)
    out += [(200 + i, (centre + 0.12 * draw.normal(size=dim)).tolist()) for i in range(90)]  # some link, some don't
    out += [(300 + i, out[3][1]) for i in range(30)] + [(340 + i, [2 * x for x in out[3][1]]) for i in range(3)]
    out += [(400, None), (401, []), (402, [0.0] * dim), (403, [1.0, None] + [0.0] * (dim - 2)), (404, [float("nan")] * dim),
            (405, [float("inf")] + [1.0] * (dim - 1)), (406, [3e38] * dim), (407, [1e-38] * dim), (408, [-0.0] * (dim - 1) + [1.0]),
            (409, [0.0] * (dim - 1) + [2.0]), (410, [1.0, 0.0]), (411, [1.0, 0.0]), (412, [5.0]), (None, out[5][1]), (5, out[5][1]), (None, None)]
    return [(i, v, 0, 7, "clash", 1) for i, v in out]


def plain_links(rows, threshold):
    good = [(k, np.array(r[1], float)) for k, r in enumerate(rows)
            if r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    near = defaultdict(set)
    for a, (k, x) in enumerate(good):
        for m, y in good[a + 1:]:
            if len(x) == len(y):
                p, q = x / np.abs(x).max(), y / np.abs(y).max()
                if p @ q / np.sqrt((p @ p) * (q @ q)) >= threshold:
                    near[k].add(m)
                    near[m].add(k)
    root = {}
    for k in range(len(rows)):
        reached, todo = {k}, [k]
        while todo:
            more = near[todo.pop()] - reached
            reached |= more
            todo += more
        ids = [rows[m][0] for m in reached if rows[m][0] is not None]
        root[k] = min(ids, default=None)
    return sorted(((rows[k][0], len(near[k]), root[k]) for k in range(len(rows))), key=str)


@pytest.mark.parametrize("tile, block, threshold", [(8, 24, 0.95), (64, 100, 0.95), (1 << 10, 1 << 14, 0.8)])
def test_links_are_those_of_all_pairs(spark, tile, block, threshold):
    rows = spark.createDataFrame(vectors(), VECTORS).repartition(4)
    got = similar.linked(rows, threshold=threshold, tile=tile, block=block).select("vec_id", "n_links", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == plain_links([(i, None if v is None else [
        None if x is None else float(np.float32(x)) for x in v]) for i, v, *_ in vectors()], threshold)


def test_a_product_at_the_threshold_links(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.5, 0.8])], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in similar.linked(rows, threshold=0.6).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_pairs_stop_before_their_last_components():
    draw = np.random.default_rng(1)
    x = similar.units(draw.normal(size=(300, 64)))
    y = similar.units(np.concatenate([x[:40] + 0.01 * draw.normal(size=(40, 64)), draw.normal(size=(200, 64))]))
    i, j, near = similar.reach(x.astype(np.float32), y.astype(np.float32), 0.95)
    want = np.argwhere(x @ y.T >= 0.95)
    assert {tuple(p) for p in want.tolist()} <= set(zip(i.tolist(), j.tolist()))
    assert len(i) < 60 and np.abs(near - (x @ y.T)[i, j]).max() < 1e-5


def test_boxes_rule_out_most_tiles_of_clusters():
    draw = np.random.default_rng(2)
    x = similar.units(np.repeat(draw.normal(size=(40, 16)), 100, axis=0) + 0.05 * draw.normal(size=(4000, 16)))
    nodes = similar.grow_tree(x[:, :similar.LEAD], 32)
    leaf = similar.leaf_of(nodes, x[:, :similar.LEAD])
    low = np.array([x[leaf == k, :similar.LEAD].min(axis=0) for k in np.unique(leaf)])
    high = np.array([x[leaf == k, :similar.LEAD].max(axis=0) for k in np.unique(leaf)])
    near = similar.apart(low[:, None], high[:, None], low[None], high[None]) <= 0.1
    assert near.diagonal().all() and near.mean() < 0.2


def test_no_vectors(spark):
    assert not similar.linked(spark.createDataFrame([], VECTORS)).collect()


# --- phrases ---

def plain_phrases(rows, least, first):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(words)
            for k in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, c in f.items():
        found = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in found.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in found.items()):
                continue
            s, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-s, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:first], 1)]
    return sorted(out)


def phrase_rows():
    draw = random.Random(8)
    common = ["a", "B", "cé", "d;", "e", "x.y", "🙂", "\x1c", "of\tthe", "the\nof"]
    more = [(i, " ".join(draw.choice(common) for _ in range(40)), draw.choice(["aa", "bb", None, "und"]), "s", 1, "x", 1, False, .5) for i in range(60)]
    return data.rows() + more


@pytest.mark.parametrize("memory", [{}, {"part": 1 << 14, "hold": 3000, "burst": 40}, {"part": 2000, "hold": 100, "burst": 4}])
def test_phrases_are_those_of_plain_counts(spark, memory):
    rows = spark.createDataFrame(phrase_rows(), data.SCHEMA).repartition(3)
    got = collocations.collocations(rows, least=4, first=150, **memory).collect()
    assert sorted(map(tuple, got)) == plain_phrases(phrase_rows(), 4, 150)


def test_heavy_prefixes_are_split_and_added_up_again(spark):
    text = " ".join(f"of the {x} {y}" for x in "abcdefgh" for y in "stuvw")
    rows = [(i, text, "en", "s", 1, "x", 1, False, .5) for i in range(9)]
    frame = spark.createDataFrame(rows, data.SCHEMA)
    texts = collocations._texts(frame, "text", "lang")
    assert len(collocations.heavy_prefixes(texts, 9 * len(text), 300))
    got = collocations.collocations(frame, least=5, part=300).collect()
    assert sorted(map(tuple, got)) == plain_phrases(rows, 5, 2000)


def test_large_counts_stay_exact():
    words = collocations.Sorted([b"w", b"x", b"y"])
    rows, counts = np.array([[2, 3, 0, 0], [3, 0, 0, 0]]), np.array([1 << 60, 7])
    found = collocations.read_run(collocations.pack_run(words, rows, counts))
    assert found[0] == [b"", b"x", b"y"] and found[1].tolist() == [[1, 2, 0, 0], [2, 0, 0, 0]] and found[2].tolist() == [1 << 60, 7]


def test_no_texts_no_phrases(spark):
    assert not collocations.collocations(spark.createDataFrame([], data.SCHEMA)).collect()


# --- as registered ---

@pytest.mark.parametrize("name, table", [("op11_prefixes", "conversations"), ("op12_similar", "embeddings"), ("op13_collocations", "documents")])
def test_registered_queries_match_their_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want.fetchall()))


# --- repairs of earlier operators ---

def test_numerals_are_no_letters():
    for text in ("½", "²³", "Ⅷ", "①②", "12 34", "_"):
        assert not language.LETTER.search(text)
    for text in ("a", "é", "好", "ß", "ª"):
        assert language.LETTER.search(text)


def test_extreme_components_keep_their_sign(spark):
    rows = [(20, [-1e300, 1.0]), (40, [1e300, 0.5]), (60, [1e300, -2.0]), (61, [-1e300, 0.0]), (62, [0.5, 0.25]), (63, [0.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(frame, frame.where("vec_id % 20 = 0"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: [max(-2**63, min(2**63 - 1, math.floor(64 * x))) for x in v] for i, v in rows}
    most = 2**63 - 1
    for q, found in got.items():
        want = sorted((-max(-most, min(most, sum(a * b for a, b in zip(whole[q], whole[i])))), i) for i in whole if i != q)[:5]
        assert [(-s, i) for _, i, s in sorted(found)] == want


def test_kept_names_may_clash(spark):
    frame = spark.createDataFrame([(1, "a b", 5, "x", 0.5)], "doc_id long, text string, n_tokens int, bpe_text string, score double")
    got = bpe.encoded(frame, PATH, public_tokenizers.PATTERN, keep=("doc_id", "n_tokens", "bpe_text")).first().asDict()
    assert got["n_tokens"] == 5 and got["n_tokens_"] == len(got["ids"]) and got["bpe_text"] == "x"
    model = toxicity.Model(toxicity.Grammar({}), None)
    assert toxicity.scored(frame, model, keep=("score", "doc_id")).columns == ["score", "doc_id", "score_"]


def test_pieces_outlive_a_change_of_generation():
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN, remember=10)
    draw = random.Random(1)
    texts = [" ".join(draw.choice(["alpha", "béta", "gamma", f"w{draw.randint(0, 60)}"]) for _ in range(15)) for _ in range(60)]
    once = [codec.encode(t) for t in texts]
    assert once == [codec.encode(t) for t in texts] and len(codec.pieces) + len(codec.pieces.before) < 80
    assert ["".join(codec.decode(ids)) for ids in once] == texts
