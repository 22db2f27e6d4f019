"""Benchmark decontamination by latent semantic retrieval.

1.  Words are runs of letters and digits, lower-cased.  The vocabulary is that of the
    benchmark items; document frequencies of its terms are counted over all passages
    of all documents (runs of ``stride`` words).
2.  A randomised SVD of the TF-IDF passages (all items, and all passages of all documents)
    gives ``rank`` latent directions: ``power`` rounds of subspace iteration with ``EXTRA``
    more columns on one matrix, in which items weigh as much as the documents, and a
    Rayleigh-Ritz step.  One pass over the documents sums A'A, an entry for each two terms
    that share a passage, in tasks and on the cluster; each round multiplies these sums
    in tasks, the driver makes the products orthogonal.
3.  Items are indexed by passages of ``2 * stride`` words as well.  Every passage of
    every document (``2 * stride`` words, from each ``stride`` on) is compared with every
    item passage by cosine in the latent space, in blocks of a matrix product; pairs
    of at least ``cosine`` are candidates, whatever words they share.
4.  A candidate is confirmed on the words themselves: the longest common subsequence of
    item and a stretch of the passage's surroundings, at most twice as long as the item,
    must cover ``coverage`` of the item; or ``paraphrase`` of it, if the item's answer
    (its ``answer`` column, else its last ``answer_words`` words) stands there word for
    word.

Items are taken in blocks of about ``BLOCK``, each with an index of its own; documents are
read three times, for frequencies, for A'A and for the search, however many blocks there
are.  A task holds all items, some 3 KB each, and up to some ``3 * PAIRS`` entries of A'A a block.
Null and empty texts match nothing, an item without words is never matched, items with
equal texts are all reported, and rows with equal ids are reported together.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import saved, shared_dir
from .text import Table, Words, buffers, lean, slices

BLOCK = 4096
EXTRA = 16
PAIRS = 1 << 20
_FOLD = bytearray(range(256))
for _c in range(128):
    _FOLD[_c] = _c if chr(_c).isalnum() else 32
for _c in range(65, 91):
    _FOLD[_c] = _c + 32
FOLD = bytes(_FOLD)


def words_of(data: np.ndarray, at: np.ndarray) -> Words:
    raw = np.frombuffer(data[at[0] : at[-1]].tobytes().translate(FOLD), np.uint8).copy()
    lead = np.flatnonzero(raw == 0xC3)
    lead = lead[lead + 1 < len(raw)] + 1
    upper = lead[(raw[lead] < 0x9F) & (raw[lead] != 0x97)]
    raw[upper] += 0x20
    return Words(raw, at - at[0], lower=False)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a bit for each element of ``a``."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x)
        if m:
            u = v & m
            v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def tightest(own: list[int], text: list[int], common: int) -> tuple[int, int]:
    """First and last + 1 word of ``text`` after cutting what stands before and after without loss of ``common``."""
    a, z = 0, len(text)
    step = 1 << max(0, len(text).bit_length() - 1)
    while step:
        if a + step < z and lcs(own, text[a + step : z]) == common:
            a += step
        else:
            step //= 2
    step = 1 << max(0, len(text).bit_length() - 1)
    while step:
        if z - step > a and lcs(own, text[a : z - step]) == common:
            z -= step
        else:
            step //= 2
    return a, z


def row_sums(row: np.ndarray, term: np.ndarray, n: int, table: np.ndarray, value: np.ndarray | None = None) -> np.ndarray:
    """For entries sorted by row, each row's sum of the (weighted) rows of ``table``: first entries of all rows, then second ones, and so on."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(row):
        start = np.flatnonzero(np.diff(row, prepend=-1))
        place = np.arange(len(row)) - np.repeat(start, np.diff(np.append(start, len(row))))
        order = np.argsort(place, kind="stable")
        for part in np.split(order, np.cumsum(np.bincount(place))[:-1]):
            for lo in range(0, len(part), 1 << 14):
                p = part[lo : lo + (1 << 14)]
                out[row[p]] += table[term[p]] if value is None else table[term[p]] * value[p, None]
    return out


class Items:
    """A block of benchmark items: words, vocabulary, weights and latent vectors."""

    def __init__(self, ids: list, texts: list[str], answers: list, stride: int, answer_words: int):
        self.ids, self.stride = ids, stride
        data, at = buffers(pa.array([t or "" for t in texts], pa.string()))
        w = words_of(data, at)
        self.words = [w.hash[w.first[i] : w.first[i + 1]].tolist() for i in range(len(ids))]
        data, at = buffers(pa.array([t or "" for t in answers], pa.string()))
        w2 = words_of(data, at)
        own = [w2.hash[w2.first[i] : w2.first[i + 1]].tolist() for i in range(len(ids))]
        self.times = [Counter(x) for x in self.words]
        self.distinct = [frozenset(x) for x in self.words]
        self.answers = [o or x[-answer_words:] for o, x in zip(own, self.words)]
        self.vocabulary = np.unique(w.hash) if len(w.hash) else np.zeros(0, np.uint64)
        self.table = Table(self.vocabulary, np.arange(1, len(self.vocabulary) + 1, dtype=np.float32))
        self.idf = np.ones(len(self.vocabulary))

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        """Term number of each word, -1 for other words."""
        return self.table.get(hashes).astype(np.int64) - 1

    def weigh(self, frequency: np.ndarray, passages: int) -> None:
        self.idf = np.log((passages + 1) / (frequency + 1)) + 1e-3
        number = {int(h): i for i, h in enumerate(self.vocabulary.tolist())}
        self.number = [[number[h] for h in w] for w in self.words]
        self.passages = [(i, first) for i, n in enumerate(self.number) for first in (range(0, max(1, len(n) - self.stride), self.stride) if n else ())]  # (item, first word)

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """(row, term) entries of the items' passages."""
        own = [self.number[i][a : a + 2 * self.stride] for i, a in self.passages]
        return np.repeat(np.arange(len(own)), [len(n) for n in own]), np.array([t for n in own for t in n], np.int64)

    def project(self, row: np.ndarray, term: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
        """Sums of the weighted rows of ``q`` for entries sorted by row."""
        return row_sums(row, term, n, q * self.idf[:, None].astype(np.float32))

    def gram(self, row: np.ndarray, term: np.ndarray, n: int, q: np.ndarray) -> np.ndarray:
        """A'A times ``q`` for rows of unit length."""
        row, term, value = _entries(row, term, n, self.idf)
        value = value.astype(np.float32)
        y = row_sums(row, term, n, q, value)
        order = np.argsort(term, kind="stable")
        out = np.zeros(q.shape, np.float64)
        for lo in range(0, len(order), 1 << 15):
            o = order[lo : lo + (1 << 15)]
            start = np.flatnonzero(np.diff(term[o], prepend=-1))
            out[term[o][start]] += np.add.reduceat(y[row[o]] * value[o, None], start, axis=0)
        return out

    def index(self, basis: np.ndarray) -> None:
        self.basis = basis.astype(np.float32)
        v = self.project(*self.rows(), len(self.passages), self.basis)
        self.latent = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def search(self, w: Words, cosine: float) -> Iterator[tuple[int, int, int, float]]:
        """(document, item passage, first word of the passage, cosine) of candidate passages."""
        s = self.stride
        # blocks of s words, numbered through the slice; passage p of a document is blocks p and p + 1
        block, n = _blocks(w, s)
        term = self.terms(w.hash)
        inside = np.flatnonzero(term >= 0)
        if not len(inside):
            return
        base = np.concatenate(([0], np.cumsum(-(-w.count // s))))
        v = self.project(block[inside], term[inside], n + 1, self.basis)
        follows = np.ones(n, bool)
        follows[base[1:][w.count > 0] - 1] = False  # the last block of a document
        v = v[:n] + v[1:] * follows[:, None]
        v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
        most = max(1, (1 << 20) // len(self.passages))
        for lo in range(0, n, most):
            near = v[lo : lo + most] @ self.latent.T
            for b, k in zip(*(x.tolist() for x in np.nonzero(near >= cosine))):
                d = int(np.searchsorted(base, lo + b, "right")) - 1
                yield d, k, (lo + b - int(base[d])) * s, float(near[b, k])

    def confirm(self, passage: int, text: list[int], first: int, coverage: float, paraphrase: float) -> tuple[int, bool, int, int] | None:
        """(common words, answer found, first and last word) around a passage, or None."""
        item, within = self.passages[passage]
        own = self.words[item]
        start = first - within
        near = text[(lo := max(0, start - len(own) // 4 - self.stride)) : max(0, start + len(own) + len(own) // 4 + 2 * self.stride)]
        # what stands in both, in any order, bounds the common subsequence
        both = self.distinct[item].intersection(near)
        if sum(self.times[item][x] for x in both) < paraphrase * len(own):
            return None
        common = lcs(own, near)
        if common < paraphrase * len(own):
            return None
        answer, limit = self.answers[item], 2 * len(own)

        def says(words: list[int], a: int, z: int) -> bool:
            return bool(answer) and any(words[k : k + len(answer)] == answer for k in range(a, max(a, z - len(answer)) + 1))

        def judge(stretch: list[int], common: int) -> tuple[int, bool, int, int] | None:
            if common < coverage * len(own) and not says(stretch, 0, len(stretch)):
                return None
            a, z = tightest(own, stretch, common)
            said = says(stretch, a, z)
            # words far apart are no passage
            return (common, said, a, z) if z - a <= limit and (common >= coverage * len(own) or said) else None

        got, at = judge(near, common), 0
        if not got and len(near) > limit:
            # the longest subsequence of all is too wide or lacks the answer: look at every stretch of ``limit`` words that begins with a word of the item
            inside = [x in both for x in near]
            count = np.concatenate(([0], np.cumsum(inside)))
            for k in np.flatnonzero(inside).tolist():
                if count[min(len(near), k + limit)] - count[k] < max(paraphrase * len(own), got[0] + 1 if got else 0):
                    continue
                stretch = near[k : k + limit]
                common = lcs(own, stretch)
                if common >= paraphrase * len(own) and (not got or common > got[0]):
                    one = judge(stretch, common)
                    if one:
                        got, at = one, k
        return got and (got[0], got[1], lo + at + got[2], lo + at + got[3])


def _each(rows: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = buffers(b.column(b.num_columns - 1))
            for i, j in slices(at, 1 << 19):
                yield from fn(b, i, words_of(data, at[i : j + 1]))

    return rows.mapInArrow(lean(run), schema)


def _blocks(w: Words, s: int) -> tuple[np.ndarray, int]:
    """(passage of each word, number) for runs of ``s`` words."""
    n = -(-w.count // s)
    base = np.concatenate(([0], np.cumsum(n)))
    return base[w.doc] + (np.arange(len(w.hash)) - np.repeat(w.first[:-1], w.count)) // s, int(base[-1])


def frequencies(texts: DataFrame, blocks: list, stride: int) -> list[tuple[np.ndarray, int]]:
    """For each (broadcast) block of items: passages of all documents that have each term, and the number of passages."""

    def count(b: pa.RecordBatch, i: int, w: Words) -> Iterator[pa.RecordBatch]:
        block, n = _blocks(w, stride)
        for k, sent in enumerate(blocks):
            term = sent.value.terms(w.hash)
            inside, size = term >= 0, max(1, len(sent.value.vocabulary))
            t, c = np.unique(np.unique(block[inside] * size + term[inside]) % size, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t) + 1, k)), pa.array(np.append(t, -1)), pa.array(np.append(c, n))], names=["block", "term", "n"])

    out, total = [np.zeros(len(sent.value.vocabulary)) for sent in blocks], [0] * len(blocks)
    for k, t, n in _each(texts, count, "block long, term long, n long").groupBy("block", "term").agg(F.sum("n")).collect():  # a row for each term of the items
        if t < 0:
            total[k] = n
        else:
            out[k][t] = n
    return list(zip(out, total))


def _entries(row: np.ndarray, term: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of each distinct (row, term), sorted; rows have unit length."""
    key, count = np.unique(row * len(idf) + term, return_counts=True)
    row, term = key // max(1, len(idf)), key % max(1, len(idf))
    value = count * idf[term]
    return row, term, value / np.maximum(np.sqrt(np.bincount(row, weights=value * value, minlength=n))[row], 1e-12)


def _summed(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and their sums."""
    order = np.argsort(key)
    key = key[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    return key[start], np.add.reduceat(x[order], start) if len(start) else x


def products(texts: DataFrame, blocks: list, stride: int) -> DataFrame:
    """A'A over the passages of all ``texts``, written: (block, i, j, x) of terms that share a passage, either way round; (block, -1, -1, number of passages)."""

    def batch(k: int, key: np.ndarray, x: np.ndarray, size: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), k)), pa.array(key // size), pa.array(key % size), pa.array(x)], names=["block", "i", "j", "x"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, passages = [[(np.zeros(0, np.int64), np.zeros(0))] for _ in blocks], 0
        for b in batches:
            data, at = buffers(b.column(0))
            for i, j in slices(at, 1 << 19):
                w = words_of(data, at[i : j + 1])
                block, n = _blocks(w, stride)
                passages += n
                for k, sent in enumerate(blocks):
                    size, term = len(sent.value.vocabulary), sent.value.terms(w.hash)
                    inside = term >= 0
                    row, term, value = _entries(block[inside], term[inside], n, sent.value.idf)
                    # each entry with itself and those after it in its row
                    many = np.searchsorted(row, row, "right") - np.arange(len(row))
                    one = np.repeat(np.arange(len(row)), many)
                    two = one + np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many)
                    sums[k].append((term[one] * size + term[two], value[one] * value[two]))
                    if sum(len(key) for key, _ in sums[k][1:]) > max(PAIRS, len(sums[k][0][0])):
                        sums[k] = [_summed(*map(np.concatenate, zip(*sums[k])))]
                        if len(sums[k][0][0]) > 2 * PAIRS:
                            yield batch(k, *sums[k].pop(), size)
                            sums[k] = [(np.zeros(0, np.int64), np.zeros(0))]
        for k, sent in enumerate(blocks):
            yield batch(k, *_summed(*map(np.concatenate, zip(*sums[k]))), len(sent.value.vocabulary))
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([-1]), pa.array([-1]), pa.array([float(passages)])], names=["block", "i", "j", "x"])

    half = texts.mapInArrow(lean(pairs), "block long, i long, j long, x double").groupBy("block", "i", "j").agg(F.sum("x").alias("x"))
    ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    both = half.select("block", "x", F.explode(ways).alias("at")).select("block", "at.i", "at.j", "x")
    return saved(both.repartition("block", "i"), shared_dir(texts.sparkSession))


def _times(pairs: DataFrame, q: np.ndarray) -> np.ndarray:
    """The written product (i, j, x), both ways round, times ``q``: summed by term in each task, and over the tasks' rows."""
    sent = pairs.sparkSession.sparkContext.broadcast(q)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        out = np.zeros(q.shape)
        for b in batches:
            i, j, x = (b.column(c).to_numpy() for c in range(3))
            order = np.argsort(i, kind="stable")
            for lo in range(0, len(order), 1 << 13):
                o = order[lo : lo + (1 << 13)]
                start = np.flatnonzero(np.diff(i[o], prepend=-1))
                out[i[o][start]] += np.add.reduceat(q[j[o]] * x[o, None], start, axis=0)
        some = np.flatnonzero(out.any(1))
        for lo in range(0, len(some), 1024):
            own = some[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([r.tobytes() for r in out[own]], pa.binary())], names=["i", "row"])

    out = np.zeros(q.shape)
    for b in pairs.mapInArrow(lean(multiply), "i long, row binary").toArrow().to_batches():  # vocabulary x (rank + EXTRA) numbers, hardly a term from two tasks
        out[b.column(0).to_numpy()] += np.frombuffer(b"".join(b.column(1).to_pylist()), np.float64).reshape(b.num_rows, q.shape[1])
    sent.unpersist()
    return out


def basis_of(items: Items, found: DataFrame, rank: int, power: int) -> np.ndarray:
    """Leading directions of passages with the written products ``found`` (i, j, x) and, with the same weight in all, of the items."""
    size = len(items.vocabulary)
    row, term = items.rows()
    q = np.linalg.qr(np.random.default_rng(0).normal(size=(size, min(rank + EXTRA, size))))[0]
    passages, pairs = found.where("i < 0").agg(F.sum("x")).head()[0] or 0, found.where("i >= 0").select("i", "j", "x")
    for k in range(power + 1):
        y = _times(pairs, q) + items.gram(row, term, len(items.passages), q.astype(np.float32)) * max(1, passages) / len(items.passages)
        if k < power:
            q, _ = np.linalg.qr(y)
    h = q.T @ y
    _, turn = np.linalg.eigh((h + h.T) / 2)
    return q @ turn[:, ::-1][:, :rank]


def latent_basis(items: Items, texts: DataFrame, stride: int, rank: int, power: int) -> np.ndarray:
    """Leading directions of all passages of ``texts`` and, with the same weight in all, of the items."""
    return basis_of(items, products(texts, [texts.sparkSession.sparkContext.broadcast(items)], stride), rank, power)


def contaminated(
    df: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", answer: str = "answer",
    stride: int = 24, rank: int = 128, power: int = 3, cosine: float = 0.6, coverage: float = 0.8, paraphrase: float = 0.6, answer_words: int = 5,
) -> DataFrame:
    """One row for each (document, item) found: key, item, cosine, common_words, item_words, coverage, answer_found, start_word, end_word."""
    spark = df.sparkSession
    texts = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    kept = benchmark.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text"), (F.col(answer) if answer in benchmark.columns else F.lit(None)).cast("string").alias("answer"))
    bounds = [None]
    n = kept.count()
    blocks = -(-n // BLOCK)
    if blocks > 1:
        kept = kept.withColumn("part", F.pmod(F.xxhash64("item", "text"), F.lit(2 * blocks)))
        bounds = list(range(2 * blocks))
    lists = [(kept if part is None else kept.where(F.col("part") == part)).select("item", "text", "answer").orderBy("item", "text").collect() for part in bounds]
    every = [Items([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], stride, answer_words) for rows in lists if rows]
    every = [items for items in every if len(items.vocabulary)]
    out = _search(texts, every, stride, rank, power, cosine, coverage, paraphrase) if every else spark.createDataFrame([], _FOUND)
    best = out.groupBy("key", "item").agg(F.max_by(F.struct(*[c for c in out.columns if c not in ("key", "item")]), F.struct("common_words", "cosine", -F.col("start_word"))).alias("b"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "b.*")


_FOUND = "key long, item long, cosine double, common_words int, item_words int, coverage double, answer_found boolean, start_word int, end_word int"


def _search(texts: DataFrame, every: list[Items], stride: int, rank: int, power: int, cosine: float, coverage: float, paraphrase: float) -> DataFrame:
    spark = texts.sparkSession
    sc = spark.sparkContext
    for items, (frequency, passages) in zip(every, frequencies(texts.select("text"), [sc.broadcast(items) for items in every], stride)):
        items.weigh(frequency, passages)
    found = products(texts.select("text"), [sc.broadcast(items) for items in every], stride)
    for k, items in enumerate(every):
        items.index(basis_of(items, found.where(F.col("block") == k).drop("block"), rank, power))
    sent = [sc.broadcast(items) for items in every]

    def find(b: pa.RecordBatch, i: int, w: Words) -> Iterator[pa.RecordBatch]:
        rows, keys = [], b.column(0)
        for block in sent:
            own, words, done = block.value, {}, {}
            for d, k, first, near in own.search(w, cosine):
                if d not in words:
                    words = {d: w.hash[w.first[d] : w.first[d + 1]].tolist()}
                j = own.passages[k][0]
                got = own.confirm(k, words[d], first, coverage, paraphrase)
                if got and got[0] > done.get((d, j), (0,))[0]:
                    done[d, j] = (*got, near)
            for (d, j), (common, said, start, end, near) in done.items():
                n = len(own.words[j])
                rows.append((keys[i + d].as_py(), own.ids[j], near, common, n, common / n, said, start, end))
        if rows:
            types = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[p.split()[0] for p in _FOUND.split(", ")])

    return _each(texts, find, _FOUND)
