"""Byte-level BPE by a lazily determinised transducer.

A sequence of tokens is the BPE encoding of its bytes exactly when each two neighbours are the
encoding of theirs, so the last token of every prefix is unique: the one that is compatible with the
last token of what stands before it. A state of the transducer is the list of places where a token
may still be open (node of the vocabulary's trie, last token before it); reading a byte gives the
next state and the last token of the longer prefix. States and transitions are made when first
needed and forgotten when there are too many. Tokens are emitted once every open place agrees on
them, which is after a lookahead of the longest vocabulary entry, or at the end of a piece.

Each match of the split pattern is encoded on its own, and special tokens are ordinary text.
Decoding is a stream as well: token bytes pass an incremental UTF-8 decoder, which holds back the
bytes of a character that isn't complete yet.

* Null texts are empty: no tokens, digests of the empty string. Rows are independent of each other,
  so repeated rows and empty tables need no rule. Texts are encoded whole.
"""

from __future__ import annotations

import base64
import codecs
import hashlib
import sys
import types
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import documents, free_name, slices

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: States that a Python worker remembers at most; of pairs of tokens five times as many, of pieces twice
#: as many in each of two generations. A hundred thousand are some 300 MB at worst.
REMEMBER = 100_000
NEVER = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], remember: int = REMEMBER):
        self.ranks, self.bytes, self.remember = ranks, {i: t for t, i in ranks.items()}, remember
        self.reach = max(map(len, ranks))
        # By node of the trie and byte: the next node, the token that ends there or -1, whether more follows.
        children: list[dict[int, int]] = [{}]
        token_at: list[int] = [-1]
        for text, rank in ranks.items():
            node = 0
            for byte in text:
                after = children[node].get(byte)
                if after is None:
                    after = children[node][byte] = len(children)
                    children.append({})
                    token_at.append(-1)
                node = after
            token_at[node] = rank
        self.nodes = [{byte: (to, token_at[to], bool(children[to])) for byte, to in node.items()} for node in children]
        self.fits: dict[int, bool] = {}
        self.spines: tuple[dict[int, list[int]], dict[int, list[int]]] = {}, {}
        self.forget()

    def forget(self) -> None:
        start = ((0, -1),)
        self.states, self.numbers, self.moves = [start], {start: 0}, [{}]

    def merged(self, text: bytes, until: int = 1) -> list[bytes]:
        """The merges in order of rank, the leftmost first, until so many parts are left."""
        parts = [text[i:i + 1] for i in range(len(text))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank == NEVER:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int, side: int) -> list[int]:
        """A token and, ever further back in its merging, what stood at its left (0) or right (1) edge."""
        known = self.spines[side].get(token)
        if known is None:
            text = self.bytes[token]
            known = [token]
            if len(text) > 1:
                known += self.spine(self.ranks[self.merged(text, 2)[side]], side)
            self.spines[side][token] = known
        return known

    def compatible(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two.

        While the two are merged on their own, their inner edges grow along their spines, in order
        of rank. They stay apart unless the tokens at the edges merge with each other before either
        is merged on its own side; of equal ranks the leftmost goes first.
        """
        key = left << 20 | right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > 5 * self.remember:
                self.fits.clear()
            a, b = self.spine(left, 1), self.spine(right, 0)
            i, j, known = len(a) - 1, len(b) - 1, None
            while known is None:
                across = self.ranks.get(self.bytes[a[i]] + self.bytes[b[j]], NEVER)
                on_left, on_right = a[i - 1] if i else NEVER, b[j - 1] if j else NEVER
                if across < on_left and across <= on_right and across < NEVER:
                    known = False
                elif i == j == 0:
                    known = True
                elif on_left <= on_right:
                    i -= 1
                else:
                    j -= 1
            self.fits[key] = known
        return known

    def move(self, state: int, byte: int) -> tuple[int, int]:
        """The state after ``byte`` and the last token of the prefix that ends there."""
        opened, last, nodes = [], -1, self.nodes
        for node, before in self.states[state]:
            step = nodes[node].get(byte)
            if step is not None:
                after, token, more = step
                if last < 0 <= token and (before < 0 or self.compatible(before, token)):
                    last = token
                if more:
                    opened.append((after, before))
        new = (*opened, (0, last))
        number = self.numbers.get(new)
        if number is None:
            number = self.numbers[new] = len(self.states)
            self.states.append(new)
            self.moves.append({})
        self.moves[state][byte] = number, last
        return number, last

    def encode(self, piece: bytes) -> list[int]:
        """The tokens of one piece, emitted as soon as they are certain."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.remember:
            self.forget()
        out: list[int] = []
        lasts: list[int] = []  # last token of each prefix that is not emitted yet
        state, wait = 0, 4 * self.reach
        for byte in piece:
            found = self.moves[state].get(byte)
            state, last = found or self.move(state, byte)
            lasts.append(last)
            if len(lasts) >= wait:
                done = self.certain(lasts)
                out += self.back(lasts, done)
                del lasts[:done]
                wait = len(lasts) + 4 * self.reach
        return out + self.back(lasts, len(lasts))

    def back(self, lasts: list[int], end: int) -> list[int]:
        out = []
        while end > 0:
            out.append(lasts[end - 1])
            end -= len(self.bytes[lasts[end - 1]])
        return out[::-1]

    def certain(self, lasts: list[int]) -> int:
        """The last cut that every place within reach of the next token leads back to."""
        places = set(range(max(0, len(lasts) - self.reach), len(lasts) + 1))
        while len(places) > 1:
            far = max(places)
            places.discard(far)
            places.add(far - len(self.bytes[lasts[far - 1]]) if far else 0)
        return places.pop()


class Codec:
    """Encoder and decoder of whole texts. Pieces seen before are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER):
        machine, self.remember = Transducer(ranks, remember), remember

        class Pieces(dict):
            """Pieces since the last change of generation; those of the one before are taken over when met again."""

            before: dict = {}

            def __missing__(self, piece):
                found = self.before.get(piece)
                if found is None:
                    found = tuple(machine.encode(piece.encode()))
                self[piece] = found
                return found

        self.fresh, self.pieces, self.bytes = Pieces, Pieces(), machine.bytes
        self.find = regex.compile(pattern).findall

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) > 2 * self.remember:
            old, self.pieces = self.pieces, self.fresh()
            old.before, self.pieces.before = {}, old
        return list(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def decode(self, ids: list[int], at_once: int = 1 << 15):
        """The text of ``ids``, a part at a time; no part ends within a character."""
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        for i in range(0, len(ids), at_once):
            yield machine.decode(b"".join(map(self.bytes.__getitem__, ids[i:i + at_once])))
        yield machine.decode(b"", final=True)


def codec_here(ranks: dict[bytes, int], pattern: str, remember: int) -> Codec:
    """This Python worker's codec. It outlives a task, so the worker's next task finds it warm; its bounds hold throughout."""
    kept = sys.modules.setdefault("_worker_codec", types.ModuleType("_worker_codec"))
    made_for = len(ranks), hash(frozenset(ranks.items())), pattern, remember
    if getattr(kept, "made_for", None) != made_for:
        kept.codec, kept.made_for = Codec(ranks, pattern, remember), made_for
    return kept.codec


def encoded(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            with_ids: bool = True, digests: bool = False, remember: int = REMEMBER) -> DataFrame:
    """``keep`` columns with ``ids`` (array<int>) and ``n_tokens``, or with digests of ids and decoded bytes.

    A new column whose name a kept one has gets ``_`` after it. ``remember`` bounds a worker's memory and
    changes no result.
    """
    kept = [f"kept_{i}" for i in range(len(keep))]
    rows = df.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text).alias("bpe_text"))
    ranks = rows.sparkSession.sparkContext.broadcast(read_ranks(path))
    made_kinds = ["n_tokens long"] + ["ids array<int>"] * with_ids + ["ids_sha256 string", "decoded_sha256 string"] * digests
    own = df.select(*keep)
    kinds = [f"`{free_name(own, k.split()[0])}` {k.split()[1]}" for k in made_kinds]
    schema = ", ".join([f"`{c}` {f.dataType.simpleString()}" for c, f in zip(own.columns, rows.schema)] + kinds)
    names_out = [*own.columns, *(k.split("`")[1] for k in kinds)]

    def run(batches):
        codec = codec_here(ranks.value, pattern, remember)
        names = {i: str(i) for i in codec.bytes}
        for batch in slices(batches, "bpe_text"):
            made: list[list] = [[] for _ in kinds]
            for text in batch.column("bpe_text").to_pylist():
                ids = codec.encode(text or "")
                row: list = [len(ids)] + [ids] * with_ids
                if digests:
                    read = hashlib.sha256()
                    for part in codec.decode(ids):
                        read.update(part.encode())
                    row += [hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(), read.hexdigest()]
                for column, value in zip(made, row):
                    column.append(value)
            types_ = [pa.int64()] + [pa.list_(pa.int32())] * with_ids + [pa.string()] * 2 * digests
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *map(pa.array, made, types_)], names_out)

    return rows.mapInArrow(run, schema)


def op8_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encoded(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN,
                   with_ids=False, digests=True)
