"""Personal data by a skip-chain conditional random field over the mentions of each document.

Fixed patterns find e-mail addresses, network addresses, card and phone numbers; these base
spans always stay and are the labels that the field learns from.  Its nodes are all mentions of
a document: base spans, and candidates that no pattern takes (runs of digits with any marks
between them, addresses with a spelled-out "at", account names that occur in an address).  A
node has a potential for each label by its features, which leave out the marks that the fixed
patterns require.  Edges join neighbouring mentions (the chain) and, whatever their distance,
mentions that are alike: the same digits, the same last digits, the same address or the same
account name (the skips).  The mentions of one key all meet at one of them, the first base span
or else the first, so a key of n mentions has n - 1 edges, and what is certain of one reaches
all others in two steps.  Sum-product messages run for a fixed number of rounds over the loopy
graph; a candidate becomes a span of the kind whose marginal is at least ``CERTAIN``.

Potentials come from one pass over all documents: counts by cell of features and label, and by
labels of joined mentions; these tables have a fixed size.  Candidates that are like a base
span are unobserved and left out of the counts; all others count as no personal data.

Defined results: null texts are empty and have no spans; positions are code points, end
exclusive; repeated rows each give a row; without any base span in the corpus only base spans
(none) result; an empty table gives an empty result; texts of any length are read whole, in
linear time; further columns are kept by ``redact`` and ignored by ``find_personal``.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.llm.common import require

KINDS = ("email", "ip", "card", "phone")
OTHER, LABELS = len(KINDS), len(KINDS) + 1
CERTAIN = 0.5
#: Rounds of messages, the share of a message that stays from the round before, and nodes whose graphs are solved at once.
ROUNDS, DAMPING, NODES = 20, 0.5, 50_000
#: Neighbours within so many characters are joined in the chain, by two kinds of edge.
NEXT, NEAR = 16, 128
#: Pairs that the prior is worth, and the share of it in which both labels agree.
PRIOR, AGREE = 4.0, 0.9

#: Fixed patterns of the base kinds; repeats are possessive where giving back can't help.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_DIGIT = re.compile("[0-9]")
_NOT_DIGITS = re.compile("[^0-9]+")
_NUMBER = re.compile(r"[0-9](?:[\x20()\[\]./_-]{0,3}[0-9])*+")
_PIECE = re.compile(r"[^\x20]+")
_SPELLED = re.compile(r"(?:\x20at\x20|\x20?[\[({]at[\])}]\x20?)([a-z0-9-]+(?:(?:\.|\x20dot\x20|\x20?[\[({]dot[\])}]\x20?)[a-z0-9-]+)++)", re.I)
_DOT = re.compile(r"\x20?[\[({]?\bdot\b[\])}]?\x20?", re.I)
_TOKEN = re.compile(r"[A-Za-z0-9._%+-]{6,}")
_CUE = re.compile(r"([A-Za-z]+)[^A-Za-z0-9]*\Z")
#: Words before a mention that speak for a kind.
_CUES = {"mail": 0, "email": 0, "contact": 0, "ip": 1, "host": 1, "address": 1, "server": 1, "card": 2, "visa": 2, "credit": 2, "tel": 3, "phone": 3, "call": 3, "fax": 3, "mobile": 3}


def _luhn(digits: str) -> bool:
    back = [int(c) for c in reversed(digits)]
    return (sum(back[::2]) + sum(d * 2 - 9 * (d > 4) for d in back[1::2])) % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and without overlap for each kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:
        own = text[done:at]
        start = done + len(own.rstrip(_LOCAL))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append((start, m.end(), "email"))
        done = m.end() if m else at + 1
        at = text.find("@", done)
    if not _DIGIT.search(text):
        return found
    found += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_byte, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGITS.sub("", m[0])) <= 19 and _luhn(d):
            found.append((*m.span(), "card"))
    if "+" in text:
        found += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGITS.sub("", m[0])) <= 15]
    return found


@dataclass
class Mention:
    start: int
    end: int
    label: int | None  # of a base span
    cell: int
    keys: tuple[str, ...] = ()
    known: bool = True


#: Sizes of the attributes of a cell, the cue first; addresses and account names use the numbers' attributes with other meanings.
SIZES = (5, 3, 20, 6, 6, 16, 2, 2)


def _cell(*values: int) -> int:
    at = 0
    for v, size in zip(values, SIZES, strict=True):
        at = at * size + v
    return at


def _cue(text: str, start: int) -> int:
    m = _CUE.search(text[max(0, start - 24) : start])
    return _CUES.get(m[1].lower(), 4) if m else 4


def _number(text: str, start: int, end: int, label: int | None = None) -> Mention | None:
    """A mention of digits: their number, the last two groups, the marks between, and whether cards' and networks' checks hold."""
    said = text[start:end]
    groups = _NOT_DIGITS.split(said.strip("+()[]. "))
    digits = "".join(groups)
    quad = len(groups) == 4 and all(map(_byte, groups))
    if label is None and not (7 <= len(digits) <= 19 or (quad and len(digits) >= 4)):
        return None
    marks = sum(1 << k for k, m in enumerate((" ", "-", ".", "()[]/_")) if any(c in said for c in m))
    last = [min(len(g), 5) for g in groups[-2:]]
    check = 12 <= len(digits) <= 19 and _luhn(digits)
    cell = _cell(_cue(text, start), 0, min(len(digits), 19), last[-1], last[0] if len(last) > 1 else 0, marks, int(check), int(quad))
    keys = (f"d{digits}",) if len(digits) >= 7 else ()
    keys += (f"t{digits[-7:]}",) if 7 <= len(digits) <= 15 and not quad else ()
    keys += (f"i{'.'.join(g.lstrip('0') or '0' for g in groups)}",) if quad else ()
    return Mention(start, end, label, cell, keys)


def _address(text: str, start: int, end: int, local: str, domain: str, strong: bool, label: int | None = None) -> Mention:
    local, domain = local.lower(), _DOT.sub(".", domain).lower()
    cell = _cell(_cue(text, start), 1, int(strong), int(bool(_DIGIT.search(local))), int(any(c in local for c in "._+-")), min(domain.count("."), 3), 0, 0)
    return Mention(start, end, label, cell, (f"e{local}@{domain}", f"l{local}"))


def mentions(text: str, base: list[tuple[int, int, str]]) -> list[Mention]:
    """The base spans and the candidates between them, in order."""
    found = []
    accounts: set[str] = set()
    for s, e, kind in base:
        if kind == "email":
            local, _, domain = text[s:e].partition("@")
            found.append(_address(text, s, e, local, domain, True, 0))
            if len(local) >= 6 and _DIGIT.search(local) and any(c.isalpha() for c in local):
                accounts.add(local.strip("._%+-").lower())
        else:
            found.append(_number(text, s, e, KINDS.index(kind)))
    digits, edges = bool(_DIGIT.search(text)), sorted((s, e) for s, e, _ in base)
    at = 0
    for s, e in [*edges, (len(text), len(text))]:
        if s > at:
            taken = []
            for m in _SPELLED.finditer(text, at, s):
                before = text[max(at, m.start() - 64) : m.start()]
                start = m.start() - len(before) + len(before.rstrip(_LOCAL))
                if start < m.start():
                    taken.append(_address(text, start, m.end(), text[start : m.start()], m[1], any(c in m[0][:4] for c in "[({")))
            if digits:
                for m in _NUMBER.finditer(text, at, s):
                    many = m.end() - m.start() > 19 and len(_NOT_DIGITS.sub("", m[0])) > 19
                    for a, b in [p.span() for p in _PIECE.finditer(text, *m.span())] if many else [m.span()]:
                        a -= a > at and text[a - 1] == "+"
                        if not (text[a - 1 : a].isalnum() or text[b : b + 1].isalnum()) and (n := _number(text, a, b)):
                            taken.append(n)
            if accounts:
                for m in _TOKEN.finditer(text, at, s):
                    name = m[0].strip("._%+-")
                    if name.lower() in accounts:
                        a = m.start() + m[0].index(name)
                        taken.append(Mention(a, a + len(name), None, _cell(_cue(text, a), 2, 0, 0, 0, 0, 0, 0), (f"l{name.lower()}",)))
            taken.sort(key=lambda n: (n.start, -n.end))
            last = at
            for n in taken:  # of two that overlap, the first
                if n.start >= last:
                    found.append(n)
                    last = n.end
        at = max(at, e)
    found.sort(key=lambda n: (n.start, n.end, LABELS if n.label is None else n.label))
    return found


#: Kinds of edges: the chain's two, then the skips by the first letters of their keys.
EDGES = 5
_SKIPS = {"d": 2, "i": 2, "e": 2, "t": 3, "l": 4}


def edges(nodes: list[Mention]) -> list[tuple[int, int, int]]:
    """(u, v, kind of edge) of the graph of one document; marks candidates that are like a base span as unobserved."""
    out = []
    for k in range(1, len(nodes)):
        gap = nodes[k].start - nodes[k - 1].end
        if gap <= NEAR:
            out.append((k - 1, k, 0 if gap <= NEXT else 1))
    by: dict[str, list[int]] = defaultdict(list)
    for k, n in enumerate(nodes):
        for key in n.keys:
            by[key].append(k)
    joined: set[tuple[int, int]] = set()
    for key in sorted(by, key=lambda k: (_SKIPS[k[0]], by[k][0], k)):
        own = by[key]
        if len(own) < 2:
            continue
        centre = next((k for k in own if nodes[k].label is not None), own[0])
        for k in own:
            if nodes[centre].label is not None and nodes[k].label is None:
                nodes[k].known = False
            pair = (min(k, centre), max(k, centre))
            if k != centre and pair not in joined:
                joined.add(pair)
                out.append((centre, k, _SKIPS[key[0]]))
    return out


@dataclass
class Field:
    """Weights by attribute value and label, and potentials by kind of edge and both labels; no weights without base spans."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, LABELS)))
    edge: np.ndarray = field(default_factory=lambda: np.zeros((EDGES, LABELS, LABELS)))

    def unary(self, cells: np.ndarray) -> np.ndarray:
        return self.weights[_attributes(cells)].sum(1)

    def marginals(self, cells: np.ndarray, labels: np.ndarray, joins: np.ndarray) -> np.ndarray:
        """Label probabilities of nodes (label -1: open) whose graph has the edges ``joins`` (u, v, kind), by loopy sum-product."""
        own = self.unary(cells)
        fixed = labels >= 0
        own[fixed] = -60.0
        own[fixed, labels[fixed]] = 0.0
        if len(joins):
            source, target = np.concatenate((joins[:, 0], joins[:, 1])), np.concatenate((joins[:, 1], joins[:, 0]))
            table = np.concatenate((self.edge[joins[:, 2]], self.edge[joins[:, 2]].transpose(0, 2, 1)))
            m, back = np.zeros((len(source), LABELS)), np.roll(np.arange(len(source)), len(joins))
            for _ in range(ROUNDS):
                belief = own + self._gather(m, target, len(own))
                sent = belief[source] - m[back]
                new = np.logaddexp.reduce(sent[:, :, None] + table, axis=1)
                new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
                m = DAMPING * m + (1 - DAMPING) * new
            own = own + self._gather(m, target, len(own))
        return np.exp(own - np.logaddexp.reduce(own, axis=1, keepdims=True))

    @staticmethod
    def _gather(m: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(target, m[:, k], n) for k in range(LABELS)], axis=1)


_OFFSETS = np.concatenate(([0], np.cumsum([SIZES[0], *(SIZES[1] * s for s in SIZES[2:])])))


def _attributes(cells: np.ndarray) -> np.ndarray:
    """The weights that a cell has: its cue, and each other attribute for its class."""
    cells, values = np.asarray(cells, np.int64), []
    for size in reversed(SIZES):
        values.append(cells % size)
        cells = cells // size
    cue, kind, *rest = reversed(values)
    return np.stack([cue, *(o + kind * s + v for o, s, v in zip(_OFFSETS[1:-1], SIZES[2:], rest, strict=True))], axis=1)


def fit(cells: dict[tuple[int, int], int], pairs: dict[tuple[int, int, int], int], steps: int = 200, penalty: float = 0.1) -> Field:
    """Weights by penalised likelihood of the labels given the cells, each cell with one more count of ``OTHER``; edge potentials by shares of label pairs.

    The steps go by a fixed bound of the curvature, so each of them raises the likelihood.
    """
    if not any(label != OTHER for _, label in cells):
        return Field()
    named = np.array(sorted({c for c, _ in cells}), np.int64)
    n = np.zeros((len(named), LABELS))
    for (c, label), count in cells.items():
        n[np.searchsorted(named, c), label] = count
    n[:, OTHER] += 1
    at, size = _attributes(named), int(_OFFSETS[-1])
    total = n.sum(1)
    bound = np.zeros((size, size))
    for a in range(at.shape[1]):
        for b in range(at.shape[1]):
            np.add.at(bound, (at[:, a], at[:, b]), total / 2)
    step = np.linalg.inv(bound + penalty * np.eye(size))
    w = np.zeros((size, LABELS))
    for _ in range(steps):
        z = w[at].sum(1)
        rest = n - total[:, None] * np.exp(z - np.logaddexp.reduce(z, axis=1, keepdims=True))
        grad = -penalty * w
        for a in range(at.shape[1]):
            np.add.at(grad, at[:, a], rest)
        w += step @ grad
    got = np.zeros((EDGES, LABELS, LABELS))
    for (kind, a, b), count in pairs.items():
        got[kind, a, b] += count
    got[2:] = got[2:] + got[2:].transpose(0, 2, 1)  # skips have no direction
    share = n.sum(0) / n.sum()
    chance = np.outer(share, share)
    agree = {False: chance, True: AGREE * np.diag(share) + (1 - AGREE) * chance}
    pooled = got[2:].sum(0)
    edge = np.zeros_like(got)
    for kind in range(EDGES):
        prior = agree[kind >= 2]
        if kind >= 2:  # a kind of skip with few pairs is taken as skips are together
            prior = (pooled + PRIOR * prior) / (pooled.sum() + PRIOR)
        p = (got[kind] + PRIOR * prior) / (got[kind].sum() + PRIOR)
        rows, cols = (p.sum(axis=x, keepdims=True) for x in (1, 0))
        edge[kind] = np.log(np.maximum(p, 1e-9)) - np.log(np.maximum(rows * cols, 1e-9))
    return Field(w, edge)


def learn(docs: DataFrame) -> Field:
    """One pass over all documents; its counts by cell and by label pair are tables of a fixed size."""
    require(docs, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[tuple[int, int]] = Counter()
        for b in batches:
            for t in b.column(0):
                text = t.as_py() or ""
                nodes = mentions(text, base_spans(text))
                joins = edges(nodes)
                label = [OTHER if m.label is None else m.label for m in nodes]
                n.update((0, m.cell * LABELS + y) for m, y in zip(nodes, label, strict=True) if m.known)
                n.update((1 + kind, label[u] * LABELS + label[v]) for u, v, kind in joins if nodes[u].known and nodes[v].known)
        rows = [(t, k, c) for (t, k), c in n.items()]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["t", "k", "n"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "t bigint, k bigint, n bigint").groupBy("t", "k").agg(F.sum("n").alias("n"))
    cells, pairs = {}, {}
    for t, k, n in got.collect():  # at most a row for each cell and label, and for each kind of edge and two labels
        if t:
            pairs[t - 1, k // LABELS, k % LABELS] = n
        else:
            cells[k // LABELS, k % LABELS] = n
    return fit(cells, pairs)


Span = tuple[int, int, str]


def scan(texts: list[str], model: Field) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, each by start and then kind; the graphs of many texts are solved together."""
    out: list[tuple[list[Span], list[Span]]] = []
    held: list[tuple[int, list[Mention], list[tuple[int, int, int]]]] = []
    size = 0

    def solve() -> None:
        cells = np.array([n.cell for _, nodes, _ in held for n in nodes], np.int64)
        labels = np.array([-1 if n.label is None else n.label for _, nodes, _ in held for n in nodes], np.int64)
        first, joins = 0, []
        for _, nodes, own in held:
            joins += [(u + first, v + first, k) for u, v, k in own]
            first += len(nodes)
        p = model.marginals(cells, labels, np.array(joins, np.int64).reshape(-1, 3))
        best, sure = p[:, :OTHER].argmax(1), p[:, :OTHER].max(1) >= CERTAIN
        first = 0
        for doc, nodes, _ in held:
            for k, n in enumerate(nodes, first):
                if n.label is None and sure[k]:
                    out[doc][1].append((n.start, n.end, KINDS[best[k]]))
            first += len(nodes)
        held.clear()

    for text in texts:
        base = base_spans(text)
        out.append((base, list(base)))
        if len(model.weights):
            nodes = mentions(text, base)
            if any(n.label is None for n in nodes):
                held.append((len(out) - 1, nodes, edges(nodes)))
                size += len(nodes)
                if size >= NODES:
                    solve()
                    size = 0
    if held:
        solve()
    by = lambda x: (x[0], KINDS.index(x[2]))
    return [(sorted(b, key=by), sorted(e, key=by)) for b, e in out]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def find_personal(docs: DataFrame, model: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base (spans as text) and spans for each row."""
    require(docs, "doc_id", "text")
    counts = [f"n_{k}" for k in KINDS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scan([t.as_py() or "" for t in b.column(1)], model)
            n = [Counter(k for *_, k in base) for base, _ in found]
            cols = [*(pa.array([c[k] for c in n], pa.int64()) for k in KINDS), *(pa.array([joined(f[w]) for f in found], pa.string()) for w in (0, 1))]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", *counts, "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} bigint' for c in counts)}, base string, spans string")


def redact(docs: DataFrame, model: Field) -> DataFrame:
    """All rows and columns with every span of ``text`` replaced by its kind in brackets; ``n_chars``, where there is one, follows the text."""
    require(docs, "text")
    names, at = docs.columns, docs.columns.index("text")

    def cut(text: str | None, spans: list[Span]) -> str | None:
        out, done = [], 0
        for s, e, kind in spans:
            if e > done:
                out += [text[done : max(s, done)], f"[{kind.upper()}]" if s >= done else ""]
                done = e
        return "".join(out) + text[done:] if done else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            texts = [cut(t, spans) for t, (_, spans) in zip(texts, scan([t or "" for t in texts], model), strict=True)]
            cols = list(b.columns)
            cols[at] = pa.array(texts, pa.string())
            if "n_chars" in names:
                k = names.index("n_chars")
                cols[k] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.mapInArrow(run, docs.schema)


def op11_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_personal(docs, learn(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
