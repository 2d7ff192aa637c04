"""Secret scans: fixed patterns, and credential formats inferred as probabilistic automata.

The base patterns find assignments, access keys and hexadecimal strings.  Their values
are the labelled credentials: a bounded sample of them, for each kind, becomes a prefix
tree over character classes whose statistically compatible states are merged into a
probabilistic automaton, first states of one depth and then any others (Hoeffding bounds
on the shares of every class and of ending, for the two states and all that follow).
Every other run of credential characters, from the shortest labelled length on, is then
scored by its likelihood under each format against that of ordinary text, a chain of the
second order over the characters of all texts.  The base spans always stay; the automata
add spans of kind ``format``.

The automata are fitted on at most ``SAMPLE`` distinct values of each kind, those with the
smallest hash, as far as they have ``SAMPLE_CHARS`` characters together.  The characters of
ordinary text are counted over all texts, whole, but for base spans and whatever is long
enough for a candidate: runs are counted apart by length, and those from the shortest
labelled length on are left out.  The counts are a table of fixed size.

Defined results: null texts are empty and have no spans; positions are code points, end
exclusive; repeated rows each give a row; without labelled values no format is inferred
and only base spans remain; an empty table gives an empty result; further columns are
kept by ``redact`` and ignored by ``find_secrets``.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import durable, require

KINDS = ("assign", "access", "hex", "format")
SAMPLE, SAMPLE_CHARS = 400, 1 << 18
#: The log-odds that a candidate needs for each character and over all; fewer characters than LEAST can't reach the latter.
PER_CHAR, IN_ALL, LEAST = 0.5, 12.0, 8
#: Runs of so many credential characters are no ordinary text, whatever the labelled lengths.
LONG = 20
#: Values that one task merges for each kind, in numbers of other tasks.
FAN_IN = 16

_ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_WORDS = ("passw", "secret", "token", "apikey", "api_key")

Span = tuple[int, int, str]


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, value) of the fixed patterns, leftmost and without overlap for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS) or "passwd" in low:
        found += [(*m.span(), "assign", m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access", m[0]) for m in _ACCESS.finditer(text)]
    found += [(*m.span(), "hex", m[0]) for m in _HEX.finditer(text)]
    return found


def candidates(text: str, taken: list, least: int = LEAST) -> list[tuple[int, int]]:
    """Runs of credential characters that touch no span of ``taken``."""
    found = [(s, e) for s, e in (m.span() for m in _RUN.finditer(text)) if e - s >= least]
    if not taken or not found:
        return found
    spans = sorted((a, b) for a, b, *_ in taken)
    starts = [a for a, _ in spans]
    reach = list(accumulate((b for _, b in spans), max))
    return [(s, e) for s, e in found if not (k := bisect_left(starts, e)) or reach[k - 1] <= s]


#: Character classes, each with its size; all else is one class.
_CLASSES = ("0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/=", "_-.")
_OF = {c: k for k, chars in enumerate(_CLASSES) for c in chars}
_SIZE = [math.log(len(c)) for c in _CLASSES] + [math.log(1000)]
_END = -1


def classes(value: str) -> list[int]:
    return [_OF.get(c, len(_CLASSES)) for c in value]


class Automaton:
    """A probabilistic automaton over character classes: per state, log-probabilities of each class and of the end, and where classes lead."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        # The prefix tree: counts of arrivals, ends and arcs.
        arcs: list[dict[int, int]] = [{}]
        came, ended = [0], [0]
        through: list[Counter] = [Counter()]
        for v in values:
            s = 0
            came[0] += 1
            for c in classes(v):
                t = arcs[s].get(c)
                if t is None:
                    t = arcs[s][c] = len(arcs)
                    arcs.append({})
                    came.append(0)
                    ended.append(0)
                    through.append(Counter())
                through[s][c] += 1
                s = t
                came[s] += 1
            ended[s] += 1
        self.arcs, self.came, self.ended, self.through = arcs, came, ended, through
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.out = []
        k = len(_CLASSES) + 2
        for s in range(len(self.arcs)):
            total = came[s] + 0.01 * k
            self.out.append({c: math.log((n + 0.01) / total) for c, n in (*through[s].items(), (_END, ended[s]))} | {None: math.log(0.01 / total)})

    def _differ(self, n1: int, f1: int, n2: int, f2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > self.bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def _find(self, s: int) -> int:
        while self.into[s] != s:
            self.into[s] = s = self.into[self.into[s]]
        return s

    def _compatible(self, a: int, b: int) -> bool:
        stack, seen = [(a, b)], set()
        while stack:
            a, b = map(self._find, stack.pop())
            if (a, b) in seen or a == b:
                continue
            seen.add((a, b))
            if self._differ(self.came[a], self.ended[a], self.came[b], self.ended[b]):
                return False
            for c in {*self.arcs[a], *self.arcs[b]}:
                if self._differ(self.came[a], self.through[a][c], self.came[b], self.through[b][c]):
                    return False
                if c in self.arcs[a] and c in self.arcs[b]:
                    stack.append((self.arcs[a][c], self.arcs[b][c]))
        return True

    def _join(self, a: int, b: int) -> None:
        """Make two states one, and all that are reached from them by the same classes."""
        stack = [(a, b)]
        while stack:
            a, b = map(self._find, stack.pop())
            if a == b:
                continue
            self.into[b] = a
            self.came[a] += self.came[b]
            self.ended[a] += self.ended[b]
            self.through[a].update(self.through[b])
            for c, t in self.arcs[b].items():
                if c in self.arcs[a]:
                    stack.append((self.arcs[a][c], t))
                else:
                    self.arcs[a][c] = t

    def _next(self, s: int) -> list[int]:
        return [self._find(self.arcs[s][c]) for c in sorted(self.arcs[s])]

    def _merge(self) -> None:
        self.into = list(range(len(self.arcs)))
        level = [0]
        while level:  # states of one depth: a branch alone has too few arrivals to tell anything
            kept: list[int] = []
            for t in (t for s in level for t in self._next(self._find(s))):
                t = self._find(t)
                if t in kept:
                    continue
                same = next((r for r in kept if self._compatible(r, t)), None)
                if same is None:
                    kept.append(t)
                else:
                    self._join(same, t)
                    kept = list(dict.fromkeys(map(self._find, kept)))
            level = kept
        red, at = [0], 0
        while at < len(red):  # states of any depth: loops
            for t in self._next(self._find(red[at])):
                t = self._find(t)
                red = list(dict.fromkeys(map(self._find, red)))
                if t in red:
                    continue
                same = next((r for r in red if self._compatible(r, t)), None)
                if same is None:
                    red.append(t)
                else:
                    self._join(same, t)
            at += 1
        self.states = len({self._find(s) for s in red})
        self.arcs = [{c: self._find(t) for c, t in own.items()} for own in self.arcs]

    def log_likelihood(self, value: str) -> float:
        s: int | None = 0
        total = 0.0
        worst = math.log(0.01 / (len(_CLASSES) + 2))
        for c in classes(value):
            total -= _SIZE[c]
            if s is None:
                total += worst
                continue
            total += self.out[s].get(c, self.out[s][None])
            s = self.arcs[s].get(c)
        return total + (worst if s is None else self.out[s].get(_END, self.out[s][None]))


#: Ordinary text: a letter's number in the chain's alphabet by its byte; 0 parts words, the last is any byte beyond ASCII.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
_LETTER = np.zeros(256, np.int32)
_LETTER[list(ALPHABET.encode())] = np.arange(1, len(ALPHABET) + 1)
_LETTER[128:] = len(ALPHABET) + 1
SYMBOLS = len(ALPHABET) + 2


def triples(texts: list[str]) -> np.ndarray:
    """Counts of three symbols in a row over the texts, each word set apart by single breaks."""
    raw = np.frombuffer(b" ".join(t.encode("utf-8", "surrogatepass") for t in texts) + b"  ", np.uint8)
    x = np.concatenate((np.zeros(1, np.int32), _LETTER[raw]))
    x = x[np.concatenate(([True], (x[1:] != 0) | (x[:-1] != 0)))]
    return np.bincount((x[:-2] * SYMBOLS + x[1:-1]) * SYMBOLS + x[2:], minlength=SYMBOLS**3)


class Words:
    """Ordinary text: a Markov chain of the second order over characters, smoothed by the shares of single ones."""

    def __init__(self, counts: np.ndarray, weight: float = 5.0):
        n = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(np.float64)
        single = n.sum((0, 1)) + 1
        single /= single.sum()
        chain = lambda x: np.log((x + weight * single) / (x.sum(-1, keepdims=True) + weight))
        self.first, self.chain = chain(n.sum(0))[0].astype(np.float32), chain(n).astype(np.float32)

    def log_likelihood(self, value: str) -> float:
        x = _LETTER[np.frombuffer(value.encode("utf-8", "surrogatepass"), np.uint8)]
        if not len(x):
            return 0.0
        before = np.concatenate(([0], x[:-2])) if len(x) > 1 else x[:0]
        return float(self.first[x[0]]) + float(self.chain[before, x[:-1], x[1:]].sum(dtype=np.float64))


class Formats:
    """All inferred formats against ordinary words."""

    def __init__(self, credentials: dict[str, list[str]], counts: np.ndarray):
        self.automata = {k: Automaton(sorted(v)) for k, v in sorted(credentials.items()) if v}
        self.words = Words(counts)
        #: A candidate must look at least as likely as all but a hundredth of the labelled credentials of that format.
        self.floor = {}
        for k, a in self.automata.items():
            own = sorted(a.log_likelihood(v) / len(v) for v in credentials[k])
            self.floor[k] = own[len(own) // 100]
        self.least = max(LEAST, min((len(v) for values in credentials.values() for v in values), default=LEAST))
        # Characters of classes that no format has cost so much that only a share of them leaves a value above the floor.
        seen = {c for a in self.automata.values() for o in a.out for c in o if c is not None and c >= 0}
        self.known = {ord(ch): None for ch, c in _OF.items() if c in seen}
        likely = max((p - _SIZE[c] for a in self.automata.values() for o in a.out for c, p in o.items() if c is not None and c >= 0), default=0.0)
        rare = max((o[None] for a in self.automata.values() for o in a.out), default=0.0) - min(_SIZE)
        self.strange = (likely - min(self.floor.values(), default=likely)) / (likely - rare) if likely > rare else 1.0

    def odds(self, value: str) -> float:
        """Log-odds of the best format that the value is likely enough for, else minus infinity."""
        own = ((k, a.log_likelihood(value)) for k, a in self.automata.items())
        return max((x for k, x in own if x >= self.floor[k] * len(value)), default=-math.inf) - self.words.log_likelihood(value)

    def finds(self, value: str) -> bool:
        if not self.automata or len(value.translate(self.known)) > self.strange * len(value):
            return False
        return self.odds(value) >= max(IN_ALL, PER_CHAR * len(value))


def _least(rows: dict[str, dict[str, int]], sample: int) -> list[tuple[str, str, int]]:
    """The ``sample`` values of each kind with the smallest hash."""
    return [(k, v, h) for k, own in sorted(rows.items()) for v, h in sorted(own.items(), key=lambda x: (x[1], x[0]))[:sample]]


def _sampled(found: DataFrame, sample: int) -> DataFrame:
    """Of rows (kind, value, h), the ``sample`` distinct values with the smallest h of each kind: tasks merge those of FAN_IN others, step by step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = defaultdict(dict)
        for b in batches:
            for kind, value, h in zip(*(c.to_pylist() for c in b.columns), strict=True):
                best[kind][value] = h
            best = defaultdict(dict, {k: dict(x[1:] for x in _least({k: own}, sample)) for k, own in best.items()})
        rows = _least(best, sample)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, d) for c, d in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64()), strict=True)], ["kind", "value", "h"])

    tasks = found.rdd.getNumPartitions()
    while tasks > 1:
        tasks = -(-tasks // FAN_IN)
        found = found.repartition(tasks).mapInArrow(run, "kind string, value string, h bigint")
    return found


def learn(docs: DataFrame, sample: int = SAMPLE) -> Formats:
    """Gather labelled values by kind (at most ``sample`` each, smallest hash first) and the counts of ordinary text, and infer the formats."""
    require(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, int]] = defaultdict(dict)
        counts: dict[int, np.ndarray] = {}  # by length of a run, 0 for all that is no candidate
        held: dict[int, list[str]] = defaultdict(list)
        size = 0

        def counted() -> None:
            for k, part in held.items():
                n = triples(part)
                counts[k] = counts[k] + n if k in counts else n
            held.clear()

        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                spans = base_spans(text)
                for _, _, kind, value in spans:
                    own = best[kind]
                    own[value] = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"), 11) >> 1
                    if len(own) > 4 * sample:
                        best[kind] = {v: h for _, v, h in _least({kind: own}, sample)}
                at, runs = 0, candidates(text, spans)
                for s, e in runs:
                    if e - s < LONG:
                        held[e - s].append(text[s:e])
                for s, e in sorted([(s, e) for s, e, *_ in spans] + runs) if spans else runs:
                    held[0].append(text[at : max(at, s)])
                    at = max(at, e)
                held[0].append(text[at:])
                size += len(text)
                if size > 1 << 21:
                    counted()
                    size = 0
        counted()
        got = {k: np.flatnonzero(n) for k, n in counts.items()}
        triple = np.concatenate([np.zeros(0, np.int64), *(k * SYMBOLS**3 + at for k, at in got.items())]).astype(np.int64)
        often = np.concatenate([np.zeros(0, np.int64), *(counts[k][at] for k, at in got.items())]).astype(np.int64)
        rows = _least(best, sample)
        kinds, values, hashes = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*kinds, *[None] * len(triple)], pa.string()),
                pa.array([*values, *[None] * len(triple)], pa.string()),
                pa.array(np.concatenate((np.array(hashes, np.int64), triple))),
                pa.array(np.concatenate((np.zeros(len(rows), np.int64), often))),
            ],
            ["kind", "value", "h", "n"],
        )

    found = durable(docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "kind string, value string, h bigint, n bigint"))
    by: dict[str, dict[str, int]] = defaultdict(dict)
    # At most ``sample`` values for each kind.
    for kind, value, h in _sampled(found.filter("kind is not null").select("kind", "value", "h"), sample).collect():
        by[kind][value] = h
    values: dict[str, list[str]] = defaultdict(list)
    room = dict.fromkeys(by, SAMPLE_CHARS)
    for kind, value, _ in _least(by, sample):
        if len(value) <= room[kind]:
            room[kind] -= len(value)
            values[kind].append(value)
    shortest = max(LEAST, min((len(v) for own in values.values() for v in own), default=LONG))
    ordinary = found.filter(f"kind is null and h < {shortest * SYMBOLS**3}").groupBy((F.col("h") % SYMBOLS**3).alias("h")).agg(F.sum("n").alias("n"))
    counts = np.zeros(SYMBOLS**3, np.int64)
    got = ordinary.toPandas()  # at most SYMBOLS ** 3 rows
    counts[got["h"].to_numpy(np.int64)] = got["n"].to_numpy(np.int64)
    return Formats(dict(values), counts)


def scan(text: str | None, formats: Formats) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind."""
    text = text or ""
    base = base_spans(text)
    own = [(s, e, kind) for s, e, kind, _ in base]
    extra = [(s, e, "format") for s, e in candidates(text, base, formats.least) if formats.finds(text[s:e])] if formats.automata else []
    by = lambda x: (x[0], KINDS.index(x[2]))
    return sorted(own, key=by), sorted(own + extra, key=by)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_secrets(docs: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base (spans as text) and spans for each row."""
    require(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1):
                base, every = scan(t.as_py(), formats)
                n = Counter(k for _, _, k in base)
                rows.append((n["assign"], n["access"], n["hex"], joined(base), joined(every)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string")


def redact(docs: DataFrame, formats: Formats, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns with every span of ``text`` replaced by ``mark``; ``n_chars``, where there is one, follows the text."""
    require(docs, "text")
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for t in b.column(at):
                text = t.as_py()
                out, done = [], 0
                for s, e, _ in scan(text, formats)[1]:
                    if e > done:
                        out += [text[done : max(s, done)], mark if s >= done else ""]
                        done = e
                texts.append(text if not done else "".join(out) + text[done:])
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, learn(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
