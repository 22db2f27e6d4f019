"""Personal data: base patterns plus a skip-chain conditional random field.

Tokens are runs of non-space characters with a digit or an ``@``.  Labels: none, email,
ip, card, phone.  Node potentials are a soft-max over shape and context features; chain
potentials tie tokens that stand within ``NEAR`` words of each other; skip potentials
tie a token to the last earlier token with the same digits or letters, however far
away (also where one's digits end in the other's), and to the last earlier such token
that is clamped, or to the first later one if none is earlier.  Loopy belief propagation
runs over each document; tokens that a base pattern covers are clamped to its label, so
evidence flows to all repetitions that the pattern misses, such as a phone number
without its country code.  A run of unclamped tokens becomes a span if every token has a
label with a belief of ``BELIEF`` or more and one of them is tied to a clamped token by
skip potentials over tokens of that label.

The potentials are trained piecewise on all documents, labelled by the base patterns:
tasks count tokens by features and label, and edges by the labels of their ends, and the
driver fits to the sums (a row for each set of features and label).  Every whole text is
scanned.  Null texts are empty and have no spans; repeated rows count as often as they
occur and give equal results; with no tokens in any document only base
spans are returned.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
NEAR, BELIEF, ROUNDS = 3, 0.9, 6
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")  # a later start in the same digits fails like the first
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_SOME = re.compile(r"[0-9@]")
_CUES = {w: i for i, ws in enumerate(("mail e-mail email contact", "ip host server address addr", "card visa credit payment account", "phone tel call mobile fax")) for w in ws.split()}


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, one look at each ``@``: the name before it reaches as far back as it can."""
    out, end, p = [], 0, text.find("@")
    while p >= 0:
        a = p
        while a > end and text[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(text, p + 1) if a < p else None
        if m:
            end = m.end()
            out.append((a, end))
        p = text.find("@", max(p + 1, end))
    return out


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """By kind as listed, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _SOME.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NOT_DIGIT.sub("", m[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append(("phone", *m.span()))
    return out


class Tokens:
    """Tokens of a text with features, clamped labels and edges."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.spans, self.places, self.features = [], [], []
        keys: dict[str, int] = {}
        self.chain: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int]] = []
        named: list[tuple[int, set[str]]] = []
        before = ""
        for place, m in enumerate(_TOKEN.finditer(text)):
            word = m[0]
            if not _SOME.search(word):
                before = word
                continue
            i = len(self.spans)
            self.spans.append(m.span())
            self.places.append(place)
            self.features.append(_features(word, before))
            if i and place - self.places[i - 1] <= NEAR:
                self.chain.append((i - 1, i))
            digits = _NOT_DIGIT.sub("", word)
            names = {digits[-k:] for k in (7, len(digits)) if len(digits) >= 7} or {word.strip(".,;:!?()[]\"'#*%$&").lower()}
            if len(digits) >= 3 or "@" in word:
                for j in sorted({keys[n] for n in names if n in keys}):
                    self.skip.append((j, i))
                keys.update((n, i) for n in names)
                named.append((i, names))
            before = word
        self.clamp = [0] * len(self.spans)
        starts = [s for s, _ in self.spans]
        for kind, a, b in base:
            k = int(np.searchsorted(starts, a, "right")) - 1
            for i in range(max(k, 0), len(self.spans)):
                if self.spans[i][0] >= b:
                    break
                if self.spans[i][1] > a and not self.clamp[i]:
                    self.clamp[i] = 1 + KINDS.index(kind)
        # a repetition is tied to a covered token itself, however many repetitions stand between
        found: dict[tuple[int, str], int] = {}
        for way in (named, named[::-1]) if base else ():
            covered: dict[str, int] = {}
            for i, names in way:
                for n in names:
                    if self.clamp[i]:
                        covered[n] = i
                    elif n in covered:
                        found.setdefault((i, n), covered[n])
        self.ties = sorted({(min(i, j), max(i, j)) for (i, _), j in found.items()} - set(self.skip))


_WIDE = 24


def _features(word: str, before: str) -> list[int]:
    """Active features: shape of the word, and what stands before it."""
    digits = sum(c.isdigit() for c in word)
    out = [0, 1 + min(digits, 19) // 3, 8 + min(word.count("."), 4)]
    out += [k for k, c in ((13, "@"), (14, "-"), (15, "("), (16, "+"), (17, "/"), (18, ":")) if c in word]
    if any(c.isalpha() for c in word):
        out.append(19)
    cue = _CUES.get(before.strip(".,;:!?()").lower())
    if cue is not None:
        out.append(20 + cue)
    return out


class Field:
    """Trained potentials."""

    def __init__(self, node: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def beliefs(self, t: Tokens) -> np.ndarray:
        """Label beliefs of each token, by loopy sum-product with damping."""
        n = len(t.spans)
        node = np.array([self.node[f].sum(0) for f in t.features])
        clamp = np.array(t.clamp)
        # a token that no pattern covers is not evidence against one: only covered tokens are fixed
        # (by more than the messages of all repetitions of one)
        node[clamp > 0] = -1e9
        node[clamp > 0, clamp[clamp > 0]] = 0.0
        skip = t.skip + t.ties
        edges = t.chain + skip
        if edges:
            a, b = np.array(edges).T
            pair = np.concatenate((np.repeat(self.chain[None], len(t.chain), 0), np.repeat(self.skip[None], len(skip), 0)))
            src, dst = np.concatenate((a, b)), np.concatenate((b, a))
            table = np.exp(np.concatenate((pair, pair.transpose(0, 2, 1))))
            back = np.concatenate((np.arange(len(a)) + len(a), np.arange(len(a))))
            message = np.zeros((len(src), node.shape[1]))
            for _ in range(ROUNDS):
                total = node.copy()
                np.add.at(total, dst, message)
                out = total[src] - message[back]
                out = np.exp(out - out.max(1, keepdims=True))
                new = np.log(np.einsum("ei,eij->ej", out, table) + 1e-30)
                new -= new.max(1, keepdims=True)
                message = 0.5 * message + 0.5 * new
            np.add.at(node, dst, message)
        p = np.exp(node - node.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def added(self, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
        """Spans that label consistency adds to the base spans."""
        if not base:  # consistency has nothing to start from
            return []
        t = Tokens(text, base)
        if not t.skip or all(t.clamp):
            return []
        p = self.beliefs(t)
        label = p.argmax(1)
        sure = (label > 0) & (p.max(1) >= BELIEF) & (np.array(t.clamp) == 0)
        if not sure.any():
            return []
        tied = np.array(t.clamp) > 0
        same = [(a, b) for a, b in sorted(t.skip + t.ties, key=lambda e: e[1]) if label[a] == label[b]]
        more = True
        while more:
            before = tied.sum()
            for a, b in same + same[::-1]:
                tied[a] = tied[b] = tied[a] | tied[b]
            more = tied.sum() > before
        out, i = [], 0
        while i < len(label):
            j = i + 1
            if sure[i]:
                while j < len(label) and sure[j] and label[j] == label[i] and t.places[j] == t.places[j - 1] + 1:
                    j += 1
                if tied[i:j].any():
                    a, b = t.spans[i][0], t.spans[j - 1][1]
                    while b > a + 1 and text[b - 1] in ".,;:!?#*%$&\"'|":
                        b -= 1
                    out.append((KINDS[label[i] - 1], a, b))
            i = j
        return out

    def spans(self, text: str) -> tuple[list, list]:
        base = base_spans(text)
        more = self.added(text, base)
        return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1], s[2])) if more else base


_NODE, _CHAIN, _SKIP = range(3)


def count(text: str, into: Counter) -> None:
    """Adds (node, feature bits, label) of each token, and (chain or skip, label, label) of each edge."""
    t = Tokens(text, base_spans(text))
    for f, label in zip(t.features, t.clamp):
        into[_NODE, sum(1 << k for k in set(f)), label] += 1
    for kind, edges in ((_CHAIN, t.chain), (_SKIP, t.skip)):
        for a, b in edges:
            into[kind, t.clamp[a], t.clamp[b]] += 1


def train(texts: list[str]) -> Field | None:
    counts: Counter = Counter()
    for text in texts:
        count(text, counts)
    return fitted(counts)


def fitted(counts: Counter) -> Field | None:
    """Piecewise training: soft-max regression for nodes, pointwise mutual information for edges."""
    rows, chain, skip = [], np.ones((5, 5)), np.ones((5, 5))
    for (kind, a, b), n in sorted(counts.items()):
        if kind == _NODE:
            rows.append((a, b, n))
        else:
            table = chain if kind == _CHAIN else skip
            table[a, b] += n
            table[b, a] += n
    if not rows:
        return None
    bits, labels, many = (np.array(c) for c in zip(*rows))
    x = (bits[:, None] >> np.arange(_WIDE) & 1).astype(float)
    y, share = np.eye(5)[labels], (many / many.sum())[:, None]
    w, speed = np.zeros((_WIDE, 5)), np.full((_WIDE, 5), 1e-6)
    for _ in range(200):
        s = x @ w
        p = np.exp(s - s.max(1, keepdims=True))
        g = x.T @ (share * (p / p.sum(1, keepdims=True) - y)) + 1e-4 * w
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)

    def potential(table: np.ndarray) -> np.ndarray:
        p = table / table.sum()
        return np.log(p / np.outer(p.sum(1), p.sum(0)))

    return Field(w, potential(chain), potential(skip))


def fit(df: DataFrame, text: str = "text") -> Field | None:
    """Train on the counts over all documents that have tokens."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                count(value.as_py(), counts)
        rows = [(*k, n) for k, n in counts.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * 4)], names=["kind", "a", "b", "n"])

    some = df.where(F.col(text).rlike("[0-9@]")).select(F.col(text).alias("text"))
    got = some.mapInArrow(sums, "kind long, a long, b long, n long").groupBy("kind", "a", "b").agg(F.sum("n")).collect()  # a row for each set of features and label
    return fitted(Counter({(r[0], r[1], r[2]): r[3] for r in got}))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_pii(df: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, counts by base kind, ``base`` and ``spans`` as joined strings."""
    sent = df.sparkSession.sparkContext.broadcast(field)
    kind = df.schema[key].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for value in batch.column(1):
                value = value.as_py() or ""
                base, spans = field.spans(value) if field else (base_spans(value),) * 2
                for i, k in enumerate(KINDS):
                    rows[i].append(sum(s[0] == k for s in base))
                rows[4].append(joined(base))
                rows[5].append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:4]), *(pa.array(r, pa.string()) for r in rows[4:])], names=[key, *(f"n_{k}" for k in KINDS), "base", "spans"]
            )

    return df.select(F.col(key), F.col(text)).mapInArrow(scan, f"`{key}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
