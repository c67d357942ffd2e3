"""Each operator against a plain version of itself, on awkward rows and on none."""

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
import regex
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import data
from tidemark.llm import bpe, components, dedup, language, licenses, mixing, privacy, queries, sharding, simhash, topk, toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path(bpe.VOCABULARY)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(data.rows(), data.SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], data.SCHEMA)


@pytest.fixture(scope="session")
def reference():
    ranks = bpe.read_ranks(PATH)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


# --- sharding ---

@pytest.mark.parametrize("limit", [200, 3_000, 1 << 26])
def test_shards_fit_and_split_no_further_than_needed(docs, limit):
    got = sharding.assign(docs, ["doc_id"], limit=limit, step=3).collect()
    bytes_of = Counter()
    for r in got:
        bytes_of[r["shard"]] += 0
    sizes = [len((t or "").encode()) for _, t, *_ in data.rows()]
    assert len(got) == len(sizes)
    assert sum({r["shard"]: r["shard_bytes"] for r in got}.values()) == sum(sizes)
    for r in got:
        assert r["shard_bytes"] <= limit or r["shard_rows"] == 1
    plain = {r["shard"] for r in got if "." not in r["shard"]}
    for s in plain:  # no shard's parent would have fitted
        if s:
            inside = {r["shard"]: r["shard_bytes"] for r in got if r["shard"].split(".")[0].startswith(s[:-1])}
            assert sum(inside.values()) > limit


def test_shards_equal_sql_where_none_overflows(spark, docs):
    con = duckdb.connect()
    con.register("documents", docs.where("doc_id is not null and doc_id <> 10008").distinct().toPandas())
    got = sharding.assign(docs.where("doc_id is not null and doc_id <> 10008").distinct(), ["doc_id"], limit=2_500, step=2)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(sharding.sql(2_500)).fetchall())


# --- mixing ---

def test_mix_comes_near_its_targets(docs):
    got = mixing.take(docs).collect()
    assert len(got) == len(data.rows())
    size = defaultdict(int)
    for _, text, _, source, *_ in data.rows():
        size[source] += len(data.words(text))
    order = sorted((s for s in size if s is not None)) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(size.values()), set(order)
    while True:
        level = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if 2 * size[s] < level * weight[s]}
        if not above:
            break
        for s in above:
            target[s], left = 2 * size[s], left - 2 * size[s]
        open_ -= above
    target |= {s: level * weight[s] for s in open_}
    by_size = {size[s]: target[s] for s in order}
    assert all(math.isclose(r["target"], by_size[r["source_size"]]) for r in got)
    taken, largest = Counter(), Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[r["source_size"]] += r["taken"]
        largest[r["source_size"]] = max(largest[r["source_size"]], r["size"])
    assert all(abs(taken[s] - by_size[s]) <= 3 * largest[s] for s in taken)
    assert sorted(map(str, got)) == sorted(map(str, mixing.take(docs.repartition(3)).collect()))


def test_the_mix_itself_repeats_rows(docs):
    times = Counter()
    for r in mixing.take(docs).collect():
        times[r["doc_id"]] += r["taken"]
    rows = mixing.repeated(docs)
    assert rows.columns == docs.columns
    words = Counter()
    for r in rows.collect():
        words[r["doc_id"]] += len(data.words(r["text"]))
    assert {k: v for k, v in times.items() if v} == {k: v for k, v in words.items() if v}


# --- language ---

def test_held_out_languages(docs):
    model = language.train(docs)
    assert model.languages == ["aa", "bb"]
    got = language.predict(docs, model, keep=("doc_id", "text", "lang")).collect()
    assert len(got) == len(data.rows())
    for r in got:
        assert 0 <= r["score"] <= 1
        lettered = bool(re.search(r"[^\W\d_]", r["text"] or ""))
        assert (r["lang_pred"] == "und") == (not lettered)
        if r["lang"] and r["text"] and len(r["text"]) > 60:
            assert r["lang_pred"] == r["lang"]
    kept = language.known_language(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(range(120))


def test_held_out_accuracy_on_documents(spark):
    got = queries.QUERIES["op4_language"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang_pred = lang").count() >= 0.95 * got.count()


# --- exact dedup ---

def test_filter_holds_its_keys_and_few_others():
    draw = np.random.default_rng(1)
    for n in (0, 1, 2, 17, 1000, 20_000):
        keys = draw.integers(0, 1 << 63, n).astype(np.uint64)
        made = dedup.build_filter(np.r_[keys, keys[:5]])
        assert dedup.in_filter(keys, *made).all()
        assert dedup.in_filter(draw.integers(0, 1 << 63, 20_000).astype(np.uint64), *made).mean() < 0.01


@pytest.mark.parametrize("batches", [1, 2, 3])
def test_exact_classes(docs, batches):
    got = dedup.classes(docs, batches=batches).collect()
    groups = defaultdict(list)
    for i, text, *_ in data.rows():
        groups[data.squeezed(text)].append((-len(text or ""), i is None, i or 0))
    expected = []
    for norm, members in groups.items():
        keep = min(members)
        first = True
        for m in sorted(members):
            expected.append((None if m[1] else m[2], None if keep[1] else keep[2], len(members), first,
                             hashlib.sha256(norm.encode()).hexdigest()))
            first = False
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected))


def test_one_row_of_equal_texts_stays(docs):
    rows = dedup.kept_rows(docs)
    assert rows.columns == docs.columns
    texts = [data.squeezed(r["text"]) for r in rows.collect()]
    assert sorted(texts) == sorted({data.squeezed(t) for _, t, *_ in data.rows()})


# --- SimHash ---

def plain_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(ids, prints):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, i in enumerate(ids):
        least[find(k)].append(i)
    return [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(ids))]


def test_simhash_components(spark, docs, tmp_path):
    some = docs.where("doc_id is null or doc_id <> 10008")
    some.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in simhash.op10_simhash(spark, str(tmp_path)).collect()]
    rows = [(i, t) for i, t, *_ in data.rows() if i != 10008]
    prints = [plain_print(t) for _, t in rows]
    least = least_reachable([i for i, _ in rows], prints)
    assert sorted(map(str, got)) == sorted(str((i, f"{p:016x}", m)) for (i, _), p, m in zip(rows, prints, least))
    assert simhash.fingerprint(data.LONG) == plain_print(data.LONG)


def test_every_close_pair_meets_at_a_home():
    draw = random.Random(5)
    prints, pairs = [], []
    for k in range(300):
        a = draw.getrandbits(64)
        b = a
        for bit in draw.sample(range(64), draw.randint(1, 4)):
            b ^= 1 << bit
        pairs.append((a, b))
        prints += [a, b]
    held = defaultdict(set)
    homes = defaultdict(set)
    for k, p, home in zip(*simhash.anchors(np.array(prints, np.uint64).view(np.int64))):
        held[int(p) % (1 << 64)].add(int(k))
        if home:
            homes[int(p) % (1 << 64)].add(int(k))
    assert all(homes[a] & held[b] for a, b in pairs)


def test_dense_groups_keep_every_link(spark):
    draw = random.Random(6)
    centre = draw.getrandbits(64)
    prints = {draw.getrandbits(64) for _ in range(200)} | {0}
    for _ in range(700):
        x = centre
        for bit in draw.sample(range(64), 5):
            x ^= 1 << bit
        prints.add(x)
    prints = sorted(prints)
    ids = list(range(len(prints)))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    found = {r["key"]: r["root"] for r in components.components(
        simhash.links(spark.createDataFrame([(s,) for s in signed], "print long").repartition(4))).collect()}
    least = least_reachable(ids, prints)
    mine = defaultdict(set)
    for i, s in zip(ids, signed):
        mine[found.get(s, s)].add(i)
    theirs = defaultdict(set)
    for i, m in zip(ids, least):
        theirs[m].add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_one_row_of_each_component_with_null_or_shared_ids(spark):
    same = "alpha beta gamma delta epsilon zeta"
    rows = [(None, same, "a"), (None, same, "b"), (7, "other words stand here now", "c"), (7, "other words stand here now", "d"),
            (9, "other words stand here now", "e"), (None, "other words stand here now", "f"), (7, same + " eta theta iota", "g")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1))
    assert got.columns == ["doc_id", "text", "source"]
    assert sorted(r["source"] for r in got.collect()) == ["a", "c", "g"]


def test_one_of_each_component(docs):
    rows = simhash.one_of_each(docs)
    assert rows.columns == docs.columns
    classes = {(r["doc_id"], r["component_id"]) for r in simhash.classes(docs).collect()}
    assert {r["doc_id"] for r in rows.collect()} == {i for i, c in classes if i is None or i == c}


# --- byte-level BPE ---

def test_tokens_equal_the_library(docs, reference):
    got = bpe.encoded(docs, PATH, public_tokenizers.PATTERN, keep=("doc_id", "text"), digests=True).collect()
    assert len(got) == len(data.rows())
    for r in got:
        ids = reference.encode_ordinary(r["text"] or "")
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()


@pytest.fixture(scope="module")
def machine():
    return bpe.Transducer(bpe.read_ranks(PATH))


def test_every_token_encodes_itself(machine):
    assert all(machine.merged(t) == [t] for t in machine.ranks)


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab \n'étß1", max_size=200), st.text("a", max_size=900)))
def test_transducer_equals_the_library(machine, reference, text):
    pieces = regex.findall(public_tokenizers.PATTERN, text)
    assert [i for p in pieces for i in machine.encode(p.encode())] == reference.encode_ordinary(text)


def test_decoder_splits_no_character(machine):
    codec = bpe.Codec(machine.ranks, public_tokenizers.PATTERN)
    text = "🙂é你" * 50
    parts = list(codec.decode(codec.encode(text), at_once=1))
    assert "".join(parts) == text and "�" not in "".join(parts)
    assert "".join(codec.decode([machine.ranks[b"\xf0"]])) == "�"


# --- personal data ---

def plain_spans(text):
    out = []
    for k, (name, pattern) in enumerate({
            "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}.items()):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(int(x) if j % 2 == 0 else int(x) * 2 - 9 * (int(x) > 4) for j, x in enumerate(reversed(digits)))
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if name == "ip"),
                    "card": 12 <= len(digits) <= 19 and total % 10 == 0, "phone": 9 <= len(digits) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


ODD = ["", "a@b.c_d@e.f", "x@y", "a@b..c", "@a.b", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.256.1.1", "001.002.003.0255 1.2.3.99999999999",
       "4111 1111 1111 1111", "4111-1111-1111-1112", "4111  1111 1111 1111", "+1 (555) 123-4567", "+1--23", "+12345678901234567",
       "é🙂 a.b@c.de 🙂 10.0.0.1", "a@b.c@d.e", "1 2 3 4 " * 3000 + "5", "9" * 5000, "a" * 50_000 + "@", "%@%.a@b.c", "+1+1 555 123 456 789",
       "\n".join(["call +49 30 1234567 now"] * 200), None]


def test_base_spans(spark):
    frame = spark.createDataFrame(list(enumerate(ODD)) + [(100 + i, t) for i, t in enumerate(["a1@x.y +1 234 567 890 4111111111111111 "] * 2)],
                                  "doc_id long, text string")
    got = frame.select("text", privacy.base_spans(F.coalesce("text", F.lit(""))).alias("spans")).collect()
    for r in got:
        assert [(s["start"], s["order"], s["end"]) for s in r["spans"]] == plain_spans(r["text"] or ""), r["text"][:80]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("a1.@- +()_\n9", max_size=60), min_size=60, max_size=60))
def test_base_spans_of_any_text(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", privacy.base_spans(F.col("text")).alias("spans")).collect()
    for r in got:
        assert [(s["start"], s["order"], s["end"]) for s in r["spans"]] == plain_spans(r["text"]), r["text"]


def test_terms_that_disclose_are_hidden(spark):
    rows = [(i, f"note {i} Zanzibar writes to boss@firm.example about the matter {i * 7}") for i in range(6)]
    rows += [(100 + i, f"the matter {i} is about nothing") for i in range(200)]
    rows += [(400 + i, "Copied unique word near other@firm.example here") for i in range(5)]
    rows += [(500, None), (None, "x " * 10), (501, "")]
    got = {r["doc_id"]: r for r in privacy.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    assert "Zanzibar" not in got[0]["clean_text"] and "[EMAIL]" in got[0]["clean_text"] and "the matter" in got[0]["clean_text"]
    assert "unique word" in got[400]["clean_text"]  # copies are one context
    assert got[100]["clean_text"] is None and got[500]["spans"] == []
    assert [s["order"] for s in got[0]["base"]] == [0]


def test_terms_count_in_distinct_whole_texts(spark):
    draw = random.Random(5)
    other = lambda: " ".join(draw.choice(["quiet", "words", "about", "weather", "over", "there"]) for _ in range(30))
    rows = [(i, f"{other()}\nContact Jane Zanzibar, boss@firm.example\n{other()}") for i in range(40)]
    rows += [(100 + i, "Quonset by chief@firm.example") for i in range(50)]  # one text, however often
    rows += [(200 + i, f"{other()} Tarpon {other()} lead@firm.example") for i in range(10) for _ in range(20)]
    rows += [(1000 + i, other()) for i in range(300)]
    got = {r["doc_id"]: r["clean_text"] for r in privacy.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zanzibar" not in got[i] and "Jane" not in got[i] and "[EMAIL]" in got[i] for i in range(40))
    assert all(got[100 + i] == "Quonset by [EMAIL]" for i in range(50))
    assert all("Tarpon" not in got[200 + i] and "weather" in got[200 + i] for i in range(10))


def test_disclosing_terms_are_hidden_wherever_they_stand(spark):
    far = "word " * 40
    rows = [(i, f"Zanzibar first {i}\n{far}boss@firm.example {i}\nthen {far} ZANZIBAR, {'é' * (i + 3)}Zanzibar") for i in range(30)]
    rows += [(100, f"{far} nobody but zanzibar here"), (101, f"{far} nobody here"), (102, "Zanzibar x@y.example zanzibar@y.example")]
    rows += [(200 + i, f"word first then nobody here {i}") for i in range(600)]
    got = {r["doc_id"]: r for r in privacy.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i in range(30):
        assert got[i]["clean_text"] == f" first {i}\n{far}[EMAIL] {i}\nthen {far} , {'é' * (i + 3)}Zanzibar"
        assert [s["order"] for s in got[i]["spans"]] == [4, 0, 4] and len(got[i]["base"]) == 1
    assert got[100]["clean_text"] == f"{far} nobody but  here" and got[100]["base"] == []
    assert got[101]["clean_text"] is None and got[200]["clean_text"] is None
    assert got[102]["clean_text"] == " [EMAIL] [EMAIL]"


def plain_disclosures(texts):
    """(value, term) -> share, counted in distinct texts one after another."""
    with_term, with_value, together = Counter(), Counter(), Counter()
    words_in = {}
    for text in sorted({t or "" for t in texts}):
        spans, letters = plain_spans(text), list(text)
        for start, _, end in spans:
            letters[start:end] = "0" * (end - start)
        words = words_in[text] = {w.lower() for w in regex.findall(r"\p{L}{3,}+", "".join(letters))}
        held = {text[start:end] for start, _, end in spans}
        with_term.update(words)
        with_value.update(held)
        together.update((v, w) for v in held for w in words)
    shares = {}
    for (v, w), both in together.items():
        if both >= privacy.SEEN:
            n = len(words_in)
            share = math.log(both * n / (with_value[v] * with_term[w])) / math.log(n / with_value[v])
            if share >= privacy.GENERALISE:
                shares[v, w] = share
    return shares


@pytest.mark.parametrize("most", [privacy.MOST_SENT, -1])
def test_disclosures_equal_a_plain_recount(spark, monkeypatch, most):
    monkeypatch.setattr(privacy, "MOST_SENT", most)
    draw = random.Random(11)
    common, rare = [f"common{c}" for c in "abcdefgh"], [f"rare{a}{b}" for a in "abcdef" for b in "abcd"]
    people = [(f"person{c}@firm.example", f"Name{c * 3}") for c in "abcdefgh"] + [("10.0.0.7", "Gateway")]
    texts = [None, "", "", "person@nowhere.example"]
    while len(texts) < 500:
        words = draw.choices(common, k=draw.randrange(2, 9)) + draw.choices(rare, k=draw.randrange(2))
        if draw.random() < 0.3:
            value, name = draw.choice(people)
            words += [value] + [name] * (draw.random() < 0.9)
        draw.shuffle(words)
        texts += [" ".join(words)] * (draw.randrange(2, 6) if draw.random() < 0.2 else 1)
    frame = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    plain = plain_disclosures(texts)
    assert len(plain) > 8
    rows = privacy.cut_lineage(frame.select("doc_id", privacy.text_of().alias("text"), F.monotonically_increasing_id().alias("row")).withColumns(
        {"hash": F.xxhash64("text"), "spans": privacy.base_spans(F.col("text"))}))
    got = {(r["value"], r["term"]): r["share"] for r in privacy.disclosures(rows).collect()}
    assert got.keys() == plain.keys() and all(math.isclose(got[k], plain[k]) for k in plain)

    worst = defaultdict(float)
    for (_, word), share in plain.items():
        worst[word] = max(worst[word], share)
    want = Counter()
    for i, t in enumerate(texts):
        spans, letters = plain_spans(t or ""), list(t or "")
        for start, _, end in spans:
            letters[start:end] = "0" * (end - start)
        terms = [(m.start(), len(privacy.KINDS), m.end(), worst[m[0].lower()]) for m in regex.finditer(r"\p{L}{3,}+", "".join(letters))
                 if m[0].lower() in worst]
        want[i // 2, tuple((*s[:3], round(s[3], 9) if len(s) > 3 else None) for s in sorted([*spans, *terms], key=lambda s: s[:2]))] += 1
    assert want == Counter((r["doc_id"], tuple((s["start"], s["order"], s["end"], None if s["share"] is None else round(s["share"], 9))
                                               for s in r["spans"])) for r in privacy.scan(frame).collect())


# --- licenses ---

def test_licenses_equal_containment_in_whole_texts(spark):
    draw = random.Random(9)
    filler = lambda n: " ".join(draw.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(n))
    rows = []
    for k, text in enumerate(licenses.TEMPLATES.values()):
        for cut in (0, 3, 17, 100):
            rows.append((len(rows), f"{filler(cut)} {text.upper()} {filler(300)}"))
        words = text.split()
        rows.append((len(rows), f"{filler(40)} {' '.join(words[:len(words) // 2])} {filler(40)}"))
    rows += [(None, None), (1000, ""), (1001, "one two"), (1001, "one two"), (1002, filler(20_000) + licenses.TEMPLATES["mit"])]
    got = {(r["doc_id"], r["template"]) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    matcher = licenses.Matcher(licenses.TEMPLATES)
    expected = set()
    for i, text in rows:
        here = set(licenses.shingle_set(licenses.words_of(text or "")))
        expected |= {(i, n) for n, s in zip(matcher.names, matcher.sets) if len(s & here) >= 0.8 * len(s)}
    assert got == expected and (1002, "mit") in got


def test_short_templates_are_found_inside_long_texts(spark):
    filler = "lorem ipsum dolor sit amet " * 200
    rows = [(0, filler + "All rights\nRESERVED. " + filler), (1, "all rights reserved"), (2, filler + "all rights are reserved"),
            (3, "rights reserved"), (4, "é all rights reserved " * 3), (5, "Mine"), (6, filler + "mine")]
    templates = {"notice": "All rights reserved.", "word": "mine", "none": "...", "mit": licenses.TEMPLATES["mit-line"]}
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), templates).collect()
    assert {(r["doc_id"], r["template"]) for r in got} == {(0, "notice"), (1, "notice"), (4, "notice"), (5, "word"), (6, "word")}
    assert all(r["containment"] == 1.0 for r in got)
    text = {i: t.encode() for i, t in rows}
    assert {text[r["doc_id"]][r["first_byte"]:r["end_byte"]].lower().split() == [b"all", b"rights", b"reserved"]
            for r in got if r["template"] == "notice"} == {True}
    assert "All rights reserved." in licenses.TEMPLATES.values()


# --- toxicity ---

def test_grammar_scores_clauses():
    g = toxicity.Grammar({"idiot": 3.0})
    score = lambda s: g.clause(toxicity.tokens(s))
    assert score("you idiot") > score("an idiot") > score("not an idiot") > 0
    assert score("he said you idiot") < score("you idiot") < score("i will hurt you idiot")
    assert score("nothing here") == 0 and g.features("") == [0.0, 0.0, 0.0]


def test_threats_score_without_an_insult(spark):
    g = toxicity.Grammar({})
    score = lambda s: g.clause(toxicity.tokens(s))
    assert score("i will hurt you") > score("he said i will hurt you") > score("i will not hurt you") == score("burn the wood") == 0
    assert g.inputs("Fine. I will hurt you, really")[3] > 0 and g.inputs("you are fine")[3] == 0
    words = [*toxicity.THREATS]  # all words stand in toxic and other documents alike, so none is an insult
    rows = [(i, f"so i will {words[i // 5 % len(words)]} you" if i % 5 == 0 else f"so i will see you. the {words[i // 5 % len(words)]} it was")
            for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert not model.grammar.insults
    assert model.score("this evening we shall hurt them") > 0.7 > 0.3 > model.score("this evening we shall help them")


def test_rare_insults_are_learned_in_large_corpora(spark, monkeypatch):
    used = [i for i in range(20_000) if zlib.crc32(str(i).encode()) % 3 != 1]
    rare = set([i for i in used if i % 4 == 0][:10])  # 10 of some 3300 toxic training documents
    rows = [(i, f"{'zorb' if i % 4 == 0 and i not in rare else 'some'} quiet words {'grunk' if i in rare else ''}") for i in range(20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    asked = spark.createDataFrame([(1, "a grunk"), (2, "a zorb, you"), (3, "quiet"), (4, None)], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    assert {"zorb", "grunk"} <= model.grammar.insults.keys()
    sent = {r["doc_id"]: r["score"] for r in toxicity.scored(asked, model).collect()}
    monkeypatch.setattr(toxicity, "MOST_WORDS", 1)
    model = toxicity.train(docs, labels)
    assert model.table is not None and not model.grammar.insults
    joined = {r["doc_id"]: r["score"] for r in toxicity.scored(asked, model).collect()}
    assert joined.keys() == sent.keys() and all(abs(joined[i] - sent[i]) < 1e-6 for i in sent)
    assert sent[1] > 0.7 and sent[2] > 0.7 > 0.3 > sent[3] == sent[4]


def test_few_toxic_labels_are_all_sampled(spark):
    used = [i for i in range(6000) if zlib.crc32(str(i).encode()) % 3 != 1]
    toxic = set(used[::500])
    docs = spark.createDataFrame([(i, "you zorb" if i in toxic else f"quiet words {i}") for i in range(6000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i in toxic)) for i in range(6000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, sample=60)
    assert model.weights is not None and model.score("you zorb") > 100 * model.score("quiet") > 0
    assert model.score("quiet") < 0.01  # the base rate, not the sample's


def test_toxic_documents_are_found(spark):
    draw = random.Random(4)
    plain = ["some", "quiet", "words", "about", "the", "weather", "and", "you"]
    rows, marks = [], []
    for i in range(400):
        words = [draw.choice(plain) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            words.insert(draw.randint(0, 40), draw.choice(["zorb", "grunk"]))
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (None, "zorb zorb")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(
        marks + [(0, 1), (None, 1), (901, None)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, toxicity.train(docs, labels)).collect()}
    assert all((got[i] >= 0.7) == bool(t) for i, t in marks)
    assert got[900] == got[901] < 0.3 and got[None] > 0.7
    assert {r["score"] for r in toxicity.scored(docs, toxicity.train(docs, labels.limit(0))).collect()} == {0.0}


# --- top-k ---

def plain_top(rows, k):
    whole = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole[n] = (i, [math.floor(64 * float(np.float32(x))) for x in v])
    out = []
    for i, v in whole.values():
        if i % 20 == 0:
            near = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in whole.values() if j != i and len(w) == len(v))
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near[:k])]
    return sorted(out)


def test_top_k_equals_brute_force(spark):
    draw = np.random.default_rng(8)
    rows = [(int(i), [float(x) for x in v]) for i, v in enumerate(draw.normal(0, 1, (900, 6)).astype(np.float32))]
    rows += [(2000 + i, [0.5] * 6) for i in range(300)]
    rows += [(4000, None), (4020, [None] * 6), (4040, [float("nan")] * 6), (4060, [float("inf")] * 6), (4080, []), (4100, [1.0]),
             (4120, [2.0]), (4121, [3.0]), (None, [0.5] * 6), (4140, [3e6] * 6), (4141, [-3e6] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard, block in ((1 << 13, 1 << 11), (150, 7)):
        got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), shard_rows=shard, block_rows=block)
        assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect())) == plain_top(rows, 20)


# --- nothing in, nothing out; the registered queries; the pipeline ---

def test_empty_tables(spark, none):
    made = [sharding.assign(none, ["doc_id"]), mixing.take(none), mixing.repeated(none), language.known_language(none),
            dedup.classes(none), dedup.kept_rows(none), simhash.classes(none), simhash.one_of_each(none),
            bpe.encoded(none, PATH, public_tokenizers.PATTERN), privacy.scan(none), licenses.scan(none),
            toxicity.scored(none, toxicity.train(none, spark.createDataFrame([], "doc_id long, toxic int"))),
            topk.top_k(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2)]
    assert [m.count() for m in made] == [0] * len(made)


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_registered_queries_equal_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    theirs = con.execute(queries.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, theirs.fetchall()))


def test_pipeline_against_its_plain_version(spark, reference):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    lettered = {i: r for i, r in rows.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    groups = defaultdict(list)
    for i, r in lettered.items():
        groups[data.squeezed(r["text"])].append((-len(r["text"]), i))
    single = sorted(min(g)[1] for g in groups.values())
    least = least_reachable(single, [plain_print(rows[i]["text"]) for i in single])
    left = [i for i, m in zip(single, least) if i == m]
    mixed = mixing.take(docs.where(F.col("doc_id").isin(left))).collect()
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["size"] and r["taken"]}
    assert Counter(r["doc_id"] for r in got) == Counter(times)
    assert all(r["ids"] == reference.encode_ordinary(rows[r["doc_id"]]["text"]) for r in got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "simhash_dedup", "mixing", "bpe"]
