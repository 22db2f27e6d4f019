"""Pattern packing by non-negative least squares.

Only the histogram of piece lengths (at most ``capacity`` numbers) reaches the driver.
Lengths are rounded up to ``bins`` steps; every pattern of at most ``depth`` steps that
fills a sequence exactly is a column, and Lawson-Hanson finds non-negative repeat
counts whose pattern lengths come closest to the histogram.  Rounded down, the counts
take real lengths from their steps, longest first.  Residual pieces go by best fit,
longest first, into the space that is left, then into new sequences.  Best fit alone
is planned as well, and the plan with fewer sequences is taken.

The plan is a list of runs "pieces of this length with these ranks go to these
sequences at this offset".  A piece's rank within its length comes from a window over
(length, salt) and from the counts of the salts before it; a length has a salt for each
``GROUP`` of its pieces, drawn without regard to their keys, so neither a common length
nor a common key makes a large task.  Pieces that fill a sequence, the bulk of long
documents, need no rank: each is its own sequence.

Null texts are documents of the end id alone.  Documents of ``capacity`` ids or fewer
are never cut.  Equal rows are packed separately.  An empty table packs to nothing.
"""

from __future__ import annotations

import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, shared_dir
from .text import lean, mix
from .tokens import encoder

GROUP = 1 << 18
_PIECE = "key long, piece int, start long, length long, ids_crc32 long"


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Lawson-Hanson: x >= 0 that minimises |a x - b|."""
    x, active = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    scale = max(1.0, float(np.abs(b).max()))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        k = int(gain.argmax())
        if active.all() or gain[k] <= 1e-9 * scale:
            break
        active[k] = True
        while True:
            own = np.flatnonzero(active)
            z = np.linalg.lstsq(a[:, own], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[own] = z
                break
            bad = z <= 0
            step = float(np.min(x[own][bad] / np.maximum(x[own][bad] - z[bad], 1e-300)))
            x[own] += step * (z - x[own])
            active[own[x[own] <= 1e-12 * scale]] = False
            x[~active] = 0
            if not active.any():
                break
    return x


def patterns(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` steps with sum ``bins``, largest first."""
    out: list[tuple[int, ...]] = []

    def more(left: int, most: int, got: tuple[int, ...]) -> None:
        if not left:
            out.append(got)
        elif len(got) < depth:
            for b in range(min(left, most), 0, -1):
                if b * (depth - len(got)) < left:
                    break
                more(left - b, b, (*got, b))

    more(bins, bins, ())
    return out


class Plan:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences."""

    def __init__(self, hist: np.ndarray):
        self.capacity = len(hist) - 1
        self.left, self.next = hist.astype(np.int64).copy(), np.zeros(len(hist), np.int64)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.sequences = 0
        self.open: dict[int, list[tuple[int, int]]] = {}  # space -> runs of sequences

    def put(self, length: int, count: int, seq: int, offset: int) -> None:
        self.runs.append((length, int(self.next[length]), count, seq, offset))
        self.next[length] += count
        self.left[length] -= count

    def leave(self, space: int, seq: int, count: int) -> None:
        if space and count:
            self.open.setdefault(space, []).append((seq, count))

    def pattern(self, steps: list[range], count: int) -> None:
        """``count`` sequences with one piece from each of the ranges of lengths."""
        now = [(self.sequences, count, 0)]
        self.sequences += count
        for lengths in steps:
            then = []
            for seq, n, used in now:
                for length in reversed(lengths):
                    k = min(n, int(self.left[length]))
                    if k:
                        self.put(length, k, seq, used)
                        then.append((seq, k, used + length))
                        seq, n = seq + k, n - k
                    if not n:
                        break
                if n:
                    then.append((seq, n, used))
            now = then
        for seq, n, used in now:
            self.leave(self.capacity - used, seq, n)

    def best_fit(self) -> None:
        """All that is left, longest first, each into the smallest space that takes it."""
        for length in range(self.capacity, 0, -1):
            spaces = sorted(s for s in self.open if s >= length)
            k = 0
            while self.left[length]:
                if k == len(spaces):
                    fit, n = self.capacity // length, int(self.left[length])
                    for count, each in ((n // fit, fit), (1 if n % fit else 0, n % fit)):
                        for i in range(each if count else 0):
                            self.put(length, count, self.sequences, i * length)
                        self.leave(self.capacity - each * length, self.sequences, count)
                        self.sequences += count
                    break
                space = spaces[k]
                own = self.open.get(space)
                if not own:
                    self.open.pop(space, None)
                    k += 1
                    continue
                seq, count = own.pop()
                n = min(count, int(self.left[length]))
                self.put(length, n, seq, self.capacity - space)
                if n < count:
                    own.append((seq + n, count - n))
                rest = space - length
                if rest >= length and rest not in spaces[k:]:
                    spaces.append(rest)
                    spaces[k:] = sorted(spaces[k:])
                self.leave(rest, seq, n)


def plan(hist: np.ndarray, bins: int = 64, depth: int = 4) -> Plan:
    """Pack pieces with ``hist[length]`` of each length into few sequences of ``len(hist) - 1``."""
    capacity = len(hist) - 1
    alone = Plan(hist)
    alone.best_fit()
    bins = min(bins, capacity)
    lowest = lambda b: (b - 1) * capacity // bins + 1
    step = {b: range(lowest(b), lowest(b + 1)) for b in range(1, bins + 1)}
    counts = np.array([hist[list(step[b])].sum() for b in range(1, bins + 1)], float)
    # only patterns whose rounded-up lengths fit: the upper ends of the steps may sum to the capacity
    listed = [p for p in patterns(bins, depth) if sum(step[b][-1] for b in p) <= capacity and all(counts[b - 1] for b in p)]
    if not listed:
        return alone
    a = np.zeros((bins, len(listed)))
    for j, p in enumerate(listed):
        for b in p:
            a[b - 1, j] += 1
    weight = np.sqrt(np.arange(1, bins + 1) / bins)  # what is left of long pieces costs more
    x = nnls(a * weight[:, None], counts * weight)
    packed, left = Plan(hist), counts.copy()
    for j in np.argsort(-x, kind="stable"):
        need = a[:, j]
        n = int(min(np.floor(x[j] + 1e-6), np.min(left[need > 0] // need[need > 0])))
        if n > 0:
            packed.pattern([step[b] for b in listed[j]], n)
            left -= n * need
    packed.best_fit()
    return packed if packed.sequences <= alone.sequences else alone


def pieces(df: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text", end_id: int = 1) -> DataFrame:
    """One row for each piece of each document: key, piece, start, length, ids_crc32, and ``spread``, a hash of its place in the input."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, at_row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for b in batches:
            keys = b.column(0).to_pylist()
            for first, ids, at in code.encode(b.column(1), end_id):
                view, rows = memoryview(ids.astype("<u4")).cast("B"), []
                for k, (a, z) in enumerate(itertools.pairwise(at.tolist())):
                    for p, s in enumerate(range(a, z, capacity)):
                        e = min(z, s + capacity)
                        rows.append((keys[first + k], p, s - a, e - s, zlib.crc32(view[4 * s : 4 * e])))
                spread = mix(np.arange(at_row, at_row + len(rows), dtype=np.uint64)) >> np.uint64(1)
                at_row += len(rows)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))), pa.array(spread.astype(np.int64))],
                    names=["key", "piece", "start", "length", "ids_crc32", "spread"],
                )

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(lean(cut), f"{_PIECE}, spread long")


def pack(cut: DataFrame, capacity: int = 4096, group: int = GROUP, **settings) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to materialised pieces."""
    hist = np.zeros(capacity + 1, np.int64)
    for r in cut.groupBy("length").count().collect():  # at most ``capacity`` rows
        hist[r[0]] = r[1]
    hist[capacity] = 0  # whole sequences
    packed = plan(hist, **settings)
    salts = np.maximum(1, -(-hist // group))
    part = cut.where(F.col("length") < capacity)
    salted = part.withColumn("salt", F.pmod(F.col("spread"), F.get(F.lit(salts.tolist()), F.col("length").cast("int"))).cast("int"))
    begin = np.cumsum(salts) - salts
    counts = np.zeros(int(salts.sum()), np.int64)
    for r in salted.groupBy("length", "salt").count().collect() if group < hist.max() else []:  # a row for each ``group`` pieces and length
        counts[begin[r[0]] + r[1]] = r[2]
    base = np.cumsum(counts) - counts
    base -= np.repeat(base[begin], salts)
    runs = np.array(sorted(packed.runs), np.int64).reshape(-1, 5)
    sc = cut.sparkSession.sparkContext
    sent = sc.broadcast((begin, base, runs))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin, base, runs = sent.value
        order = (runs[:, 0] << 44) + runs[:, 1]
        for b in batches:
            col = {n: b.column(n).to_numpy() for n in ("length", "salt", "rank")}
            rank = base[begin[col["length"]] + col["salt"]] + col["rank"] - 1
            at = np.searchsorted(order, (col["length"] << 44) + rank, "right") - 1
            own = runs[at]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in ("key", "piece", "start", "length", "ids_crc32")), pa.array(own[:, 3] + rank - own[:, 1]), pa.array(own[:, 4])],
                names=["key", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    w = Window.partitionBy("length", "salt").orderBy("key", "piece", "start", "ids_crc32", "spread")
    ranked = salted.withColumn("rank", F.row_number().over(w).cast("long")).mapInArrow(lean(place), f"{_PIECE}, sequence_id long, offset long")
    whole = cut.where(F.col("length") == capacity).drop("spread").withColumns({"sequence_id": F.monotonically_increasing_id() + packed.sequences, "offset": F.lit(0).cast("long")})
    return ranked.unionByName(whole)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 4096, key: str = "doc_id", text: str = "text", end_id: int = 1, **settings) -> DataFrame:
    """Tokenize, cut and pack; texts are read once, pieces are kept in the shared folder."""
    cut = saved(pieces(df, tokenizer, capacity, key, text, end_id), shared_dir(df.sparkSession))
    return pack(cut, capacity, **settings).withColumnRenamed("key", key)
