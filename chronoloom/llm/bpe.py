"""Byte-level BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a piece exactly one token can come last in its encoding.  The
vocabulary's automaton reports, at each position, the tokens that are suffixes of the
prefix read so far; a candidate is the last token if the pair it forms with the last
token of the remaining prefix is compatible, that is if undoing the merges on either
side of their border, latest first, never meets an earlier merge across it.  Following
the back-pointers from the end gives the ids.  Time is linear in the piece, however long.

Defined results: a null text is empty and has no ids; a special token's string in a
text becomes that token; repeated rows each give a row; further columns are kept by
``encode`` unless they clash with its own (those of the operator win).
"""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from chronoloom.llm.common import require

#: The byte-level pre-tokenizer's pattern.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words, pieces and pairs that a worker remembers, and fewer for one that also holds whole rows: half the memory for half as much time again.
MEMORY, SLIM = (360_000, 200_000, 150_000), (120_000, 60_000, 60_000)


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where printable, else one from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Memory(dict):
    """Ids by string, made when first met; long strings aren't kept."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str) -> tuple[int, ...]:
        ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = ids
        return ids


class Codec:
    def __init__(self, path: str, memory: tuple[int, int, int] = MEMORY):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(letters.__getitem__, token))
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.text = list(map(str, range(size)))
        #: Tokens are compared by when they are made: single bytes first, then in the order of the merges.
        self.halves: list[tuple[int, int] | None] = [None] * size
        self.made: list[int] = [-1] * size
        self.joined: dict[tuple[int, int], int] = {}
        for when, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, both = vocab[a], vocab[b], vocab[a + b]
            if (left, right) not in self.joined:
                self.joined[left, right] = when
                if self.halves[both] is None:
                    self.halves[both], self.made[both] = (left, right), when
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            if self.halves[i] or len(self.bytes[i]) == 1:
                self.automaton.add_word(self.bytes[i].decode("latin-1"), (i, len(self.bytes[i])))
        self.automaton.make_automaton()
        words, pieces, self.most_pairs = memory
        self.pairs: dict[tuple[int, int], bool] = {}
        self.pieces = Memory(lambda piece: self.encode_piece(piece.encode("utf-8", "surrogatepass").decode("latin-1")), pieces)
        #: A piece ends before every single space that a visible character follows, so what follows it can be remembered whole.
        self.spaced = Memory(lambda word: self.encode_part(" " + word), words)
        self.find = regex.compile(PIECES).findall
        self.plain = lambda text, search=re.compile(r" (?:\s|\Z)").search: search(text) is None
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def fits(self, pair: tuple[int, int]) -> bool:
        """Whether BPE leaves the border of the pair's bytes unmerged when both sides reach these tokens."""
        got = self.pairs.get(pair)
        if got is None:
            if len(self.pairs) >= self.most_pairs:
                self.pairs.clear()
            got = self.pairs[pair] = self._fits(*pair)
        return got

    def _fits(self, a: int, b: int) -> bool:
        """Walk back in time: a merge across the border must not come before what is undone next (left before right when equal)."""
        halves, made, joined = self.halves, self.made, self.joined
        deadline = len(joined) + 1  # merges earlier than this could have joined the border
        strict = False
        while True:
            when = joined.get((a, b))
            if when is not None and (when < deadline or (when == deadline and not strict)):
                return False
            if made[a] < 0 and made[b] < 0:
                return True
            if made[a] > made[b]:  # the left token is the later one: before that, its right half stood at the border
                deadline, strict = made[a], True
                a = halves[a][1]
            else:  # made at the same time or later on the right: a border merge of the same rank comes first, being further left
                deadline, strict = made[b], False
                b = halves[b][0]

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece given as its bytes in Latin-1."""
        n = len(piece)
        last, size = [-1] * (n + 1), [0] * (n + 1)
        known, fits = self.pairs.get, self.fits
        done = -1
        for end, (token, width) in self.automaton.iter(piece):  # longest suffix first
            if end != done:
                start = end + 1 - width
                if start:
                    pair = (last[start], token)
                    ok = known(pair)
                    if not (fits(pair) if ok is None else ok):
                        continue
                done = end
                last[end + 1], size[end + 1] = token, width
        ids = []
        while n:
            ids.append(last[n])
            n -= size[n]
        return tuple(reversed(ids))

    def encode_part(self, text: str) -> tuple[int, ...]:
        return tuple(chain.from_iterable(map(self.pieces.__getitem__, self.find(text))))

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        special = self.split is not None and any(s in text for s in self.special)
        for k, part in enumerate(self.split(text) if special else [text]):
            if k % 2:
                ids.append(self.special[part])
            elif self.plain(part):
                first, *words = part.split(" ")
                ids += self.encode_part(first)
                ids += chain.from_iterable(map(self.spaced.__getitem__, words))
            else:
                ids += self.encode_part(part)
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str, memory: tuple[int, int, int] = MEMORY) -> Codec:
    made = Codec(path, memory)
    gc.freeze()  # the tables hold no cycles; scanning them again and again costs a third of the time
    return made


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """All rows with n_tokens and ids (array of int)."""
    require(docs, "text")
    path = path or default_path()
    own = ("n_tokens", "ids")
    rest = [c for c in docs.columns if c not in own]
    kept = docs.select([F.col(f"`{c}`") for c in rest])
    schema = StructType([*kept.schema.fields, StructField("n_tokens", LongType()), StructField("ids", ArrayType(IntegerType()))])
    at = rest.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, SLIM)
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                ids = [c.encode(t or "") for t in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(len, ids)), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], [*rest, *own])

    return kept.mapInArrow(run, schema)


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the SHA-256 of the ids and of the decoded text, without shipping either."""
    require(docs, "doc_id", "text")
    path = path or default_path()
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            n, first, second = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py() or "")
                n.append(len(ids))
                first.append(hashlib.sha256(",".join(map(c.text.__getitem__, ids)).encode()).hexdigest())
                second.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
