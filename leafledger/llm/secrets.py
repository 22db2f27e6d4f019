"""Secret scan: base patterns plus sliding-window entropy over candidate strings.

A candidate is a maximal run of ``[A-Za-z0-9+/_=-]`` of at least ``min_length``
characters.  A window slides over it one character at a time, and the Shannon
entropy of the window is kept by incremental counts: the sum of ``c * log2(c)`` over
the counts changes in two places for each step.  Each character class (hex, base 64)
has its own threshold.  The allow list suppresses candidates that are plainly not
secrets: words, numbers, identifiers in snake or kebab case, paths, UUIDs, dates and
digests that a word like ``sha256`` or ``commit`` stands before.

Null texts are empty and have no spans.  Repeated rows give repeated results; only the
key and text columns are read, whatever others there are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_KEY = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")
ASSIGN = re.compile(rf"({_KEY})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # maximal runs, so the same as filtering runs by length
KINDS = ("assign", "access", "hex", "entropy")
_RUN = "[A-Za-z0-9+/_=-]"
_ALLOWED = re.compile(
    r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+)(?:[-_/+=]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+))*[-_/+=]*"  # words and numbers in a row
    r"|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"  # UUID
    r"|[-_=+/]+.{0,3}[-_=+/]*"  # rules
)
_BEFORE = re.compile(r"(?i:sha(?:1|256|512)|md5|commit|checksum|digest|integrity)[\"']?[:=\x20-]{0,3}$")
_XLOGX = [0.0] + [c * math.log2(c) for c in range(1, 4097)]


def window_entropy(text: str, width: int) -> float:
    """Largest Shannon entropy (bits a character) of any window of ``width`` characters."""
    w = min(width, len(text))
    if not w:
        return 0.0
    counts: dict[str, int] = {}
    for c in text[:w]:
        counts[c] = counts.get(c, 0) + 1
    total = sum(_XLOGX[n] for n in counts.values())
    least = total
    for old, new in zip(text, text[w:]):
        if old != new:
            a = counts[old]
            counts[old] = a - 1
            b = counts.get(new, 0)
            counts[new] = b + 1
            total += _XLOGX[a - 1] - _XLOGX[a] + _XLOGX[b + 1] - _XLOGX[b]
            least = min(least, total)
    return math.log2(w) - least / w


class Scanner:
    """Finds spans ``(kind, start, end)`` in code points."""

    def __init__(self, min_length: int = 20, width: int = 20, hex_bits: float = 3.0, base64_bits: float = 3.6):
        if not 0 < width < len(_XLOGX):
            raise ValueError("width must be between 1 and 4096")
        self.width, self.hex_bits, self.base64_bits = width, hex_bits, base64_bits
        self.runs = re.compile(_RUN + f"{{{min_length},}}")

    def base(self, text: str) -> list[tuple[str, int, int]]:
        out = []
        if ":" in text or "=" in text:
            out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
        if "AKIA" in text:
            out += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
        out += [("hex", *m.span()) for m in HEX.finditer(text)]
        return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))

    def added(self, text: str) -> list[tuple[str, int, int]]:
        """High-entropy candidates that the allow list does not suppress."""
        out = []
        for m in self.runs.finditer(text):
            run = m[0]
            if run.isalpha() or _ALLOWED.fullmatch(run) or _BEFORE.search(text[max(0, m.start() - 16) : m.start()]):
                continue
            is_hex = not run.strip("0123456789abcdefABCDEF")
            if window_entropy(run, self.width) >= (self.hex_bits if is_hex else self.base64_bits):
                out.append(("entropy", *m.span()))
        return out

    def spans(self, text: str) -> tuple[list, list]:
        """(base spans, all spans): an added span that lies within a base span is left out."""
        base = self.base(text)
        more = [s for s in self.added(text) if not any(b[1] <= s[1] and s[2] <= b[2] for b in base)]
        return base, sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per row: key, counts by base kind, ``base`` and ``spans`` as joined strings."""
    kind = df.schema[key].dataType.simpleString()
    scanner = Scanner(**settings)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            for value in batch.column(1):
                base, spans = scanner.spans(value.as_py() or "")
                for i, k in enumerate(KINDS[:3]):
                    rows[i].append(sum(s[0] == k for s in base))
                rows[3].append(joined(base))
                rows[4].append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), *(pa.array(r, pa.string()) for r in rows[3:])],
                names=[key, "n_assign", "n_access", "n_hex", "base", "spans"],
            )

    schema = f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base string, spans string"
    return df.select(F.col(key), F.col(text)).mapInArrow(scan, schema)


def masked(text: str, spans: list[tuple[str, int, int]], mask: str = "[SECRET]") -> str:
    """``text`` with every span replaced; overlapping spans become one mask."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if b > at:
            if a >= at:
                out += [text[at:a], mask]
            at = b
    return "".join(out) + text[at:]


def redact(text: str, mask: str = "[SECRET]", **settings) -> str:
    return masked(text, Scanner(**settings).spans(text)[1], mask)
