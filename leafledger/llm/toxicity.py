"""Toxicity by class-conditional Kneser-Ney models over bytes.

Texts are lower-cased and runs of white space become one space; contexts of up to
``ORDER - 1`` bytes go over the ends of words, so expressions of several words are
modelled.  For each class and each order up to ``ORDER``, (context, byte) is counted once
for each document; counts are discounted, and the discounted mass goes to the model of the
next lower order.  What both classes share is one Kneser-Ney model with continuation
counts pooled over them; a class differs from it by a log ratio of the classes at each
order.  That ratio moves from the one of the lower order only by what exceeds ``CAUTION``
standard errors of the counts, so rare expressions are smoothed through the shared
counts, and it speaks for "ordinary" with ``LEAST`` at most.  An expression that neither
class knows has the probabilities of its longest known end.

A text has two length-normalised log-likelihoods, the means over its bytes in either
model.  Their difference is its evidence; a logistic curve, fitted on evidence that each
of ``FOLDS`` folds of the training rows gets from the others' counts, turns it into a score.

All labelled ids are used for fitting, with one text each; every row is scored on its
whole text.  Labels, language, source and id are no input of a score.  Counts, and
models of orders above ``LOW``, are made on the cluster; the driver gets the counts of shorter
n-grams (24 bits at most).  The driver and every task get the n-grams whose
log ratio is not that of their end, which are all that evidence needs, and, for
likelihoods, those of no other use as well: each distinct n-gram of the training texts,
some 40 bytes.

Null and empty texts have no evidence and get the score at evidence 0, at most 0.49.
A row whose label is null does not take part in fitting, an id with several labels counts
as toxic if one is, one with several texts has the text with the smallest hash; with no
toxic or no ordinary training rows every score is 0.  Rows are scored one by one, so
repeated rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import saved, shared_dir
from .text import LOWER, SPACE, Table, buffers, lean, slices

ORDER = 5
LOW = 3
DISCOUNT = 0.75
CAUTION = 2.0
LEAST = -1.0
FOLDS = 8
BUCKETS = 1024
MOST = 1 << 20
_UNKNOWN = float(np.log(1 / 256))
_BITS = 48


def _grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams as integers, document of each): one for each byte, the first byte of a text after a space."""
    raw = np.frombuffer(data[at[0] : at[-1]].tobytes().translate(LOWER), np.uint8)
    space = SPACE[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[at - at[0]] = True
    keep = ~space
    keep[1:] |= ~(space[:-1] | first[1:-1])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))[keep]
    raw = np.where(space, 32, raw)[keep].astype(np.uint64)
    begin = np.searchsorted(doc, np.arange(len(at) - 1))
    place = np.arange(len(raw)) - begin[doc]
    key = raw.copy()
    for k in range(1, ORDER):
        byte = np.full(len(raw), 32, np.uint64)
        byte[k:] = raw[:-k] if k < len(raw) else raw[:0]
        byte[place < k] = 32
        key |= byte << np.uint64(8 * k)
    return key, doc


def _end(grams: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes, with the order in front so that ends of different orders differ."""
    return grams & np.uint64((1 << 8 * order) - 1) | np.uint64(order << _BITS)


def _discounted(grams: np.ndarray, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
    """Log-probability of the last byte of each distinct n-gram, with ``base`` the log-probabilities of the next lower order."""
    _, context = np.unique(grams >> np.uint64(8), return_inverse=True)
    total = np.bincount(context, weights=counts)
    left = np.where(total > 0, DISCOUNT * np.bincount(context, weights=counts > 0) / np.maximum(total, 1), 1.0)
    return np.log(np.maximum(counts - DISCOUNT, 0) / np.maximum(total[context], 1) + left[context] * np.exp(base))


def _orders(grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, share: float, most: int = ORDER, longer: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled log-probability, log ratio and that of its end for sorted n-grams of orders up to ``most``; ``longer``: continuations of those of order ``most``, if there are any."""
    at = np.searchsorted(grams, [np.uint64(k << _BITS) for k in range(1, most + 2)])
    pooled, ratio, lesser = np.zeros(len(grams)), np.zeros(len(grams)), np.zeros(len(grams))
    for k in range(1, most + 1):
        own = slice(at[k - 1], at[k])
        u, t, o = grams[own], toxic[own], ordinary[own]
        if k == 1:
            base, less = np.full(len(u), _UNKNOWN), np.zeros(len(u))
        else:
            lower = at[k - 2] + np.searchsorted(grams[at[k - 2] : at[k - 1]], _end(u, k - 1))
            base, less = pooled[lower], ratio[lower]
        many = np.unique(_end(grams[at[k] : at[k + 1]], k), return_counts=True)[1] if k < most else t + o if longer is None else longer
        base_o = base - np.log(share * np.exp(less) + 1 - share)
        pooled[own] = _discounted(u, many, base)
        step = _discounted(u, t, base_o + less) - _discounted(u, o, base_o) - less
        error = np.sqrt(1 / (t + 0.5) + 1 / (o + 0.5))
        ratio[own] = np.maximum(LEAST, less + np.sign(step) * np.maximum(0, np.abs(step) - CAUTION * error))
        lesser[own] = less
    return pooled, ratio, lesser


class Model:
    """Log-probabilities of known n-grams of all orders in both classes."""

    def __init__(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, share: float):
        """Distinct n-grams of all orders (see ``_end``) with the numbers of documents of either class that have them; ``share`` of these is toxic."""
        order = np.argsort(grams)
        grams = grams[order]
        pooled, ratio, _ = _orders(grams, toxic[order].astype(float), ordinary[order].astype(float), share)
        # the pooled probability is the mean of both classes' by their shares
        log_o = pooled - np.log(share * np.exp(ratio) + 1 - share)
        self._take(grams, log_o + ratio, log_o, _UNKNOWN)

    @classmethod
    def of(cls, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, unknown: float) -> Model:
        """A model of given log-probabilities of n-grams, and of unknown bytes."""
        out, order = cls.__new__(cls), np.argsort(grams)
        out._take(grams[order], toxic[order], ordinary[order], unknown)
        return out

    def _take(self, grams: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray, unknown: float) -> None:
        self.grams = Table(grams, np.arange(1, len(grams) + 1, dtype=np.int32))
        self.toxic, self.ordinary = (np.concatenate(([unknown], x)) for x in (toxic, ordinary))
        self.slope, self.bias = 1.0, 0.0

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Number of the longest known end of each n-gram, 0 if there is none."""
        out, rest = np.zeros(len(grams), np.int64), np.arange(len(grams))
        for k in range(ORDER, 0, -1):
            out[rest] = self.grams.get(_end(grams[rest], k)).astype(np.int64)
            rest = rest[out[rest] == 0]
        return out

    def likelihoods(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, length-normalised log-likelihood in the toxic and in the ordinary model) for runs of rows; 0 for empty texts."""
        data, at = buffers(column)
        for i, j in slices(at, 1 << 19):
            keys, doc = _grams(data, at[i : j + 1])
            known, n = self.known(keys), np.maximum(1, np.bincount(doc, minlength=j - i))
            yield i, *(np.bincount(doc, weights=log[known], minlength=j - i) / n for log in (self.toxic, self.ordinary))

    def evidence(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
        """(first row, toxic less ordinary log-likelihood)."""
        for i, toxic, ordinary in self.likelihoods(column):
            yield i, toxic - ordinary

    def score(self, evidence: np.ndarray, empty: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-np.clip(self.slope * evidence + self.bias, -40, 40)))
        return np.where(empty, np.minimum(p, 0.49), p)

    def calibrate(self, evidence: np.ndarray, label: np.ndarray, count: np.ndarray, spread: float, toxic_share: float) -> None:
        """Logistic curve by Newton steps with a small ridge, on means of evidence of ``count`` rows each; classes weigh as often as they occur."""
        x = np.stack((evidence / spread, np.ones(len(evidence))), 1)
        weight = count * np.where(label == 1, toxic_share / max(1, count[label == 1].sum()), (1 - toxic_share) / max(1, count[label == 0].sum()))
        w = np.zeros(2)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
            gradient = x.T @ (weight * (p - label)) + 1e-4 * w * (1, 0)
            hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
            step = np.linalg.solve(hessian, gradient)
            w -= np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-8:
                break
        self.slope, self.bias = float(w[0] / spread), float(w[1])


def _counted(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and their summed counts."""
    tags, n = map(np.concatenate, zip(*parts))
    order = np.argsort(tags)
    tags, n = tags[order], n[order]
    new = np.flatnonzero(np.concatenate((np.ones(min(1, len(tags)), bool), tags[1:] != tags[:-1])))
    return tags[new], np.add.reduceat(n, new) if len(new) else n


def count_grams(rows: DataFrame) -> DataFrame:
    """Documents of rows (text, toxic, fold) by n-gram of each order, class (bit 56) and fold (from bit 57)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for b in batches:
            data, at = buffers(b.column(0))
            tag = b.column(1).to_numpy().astype(np.uint64) << np.uint64(56) | b.column(2).to_numpy().astype(np.uint64) << np.uint64(57)
            for i, j in slices(at, 1 << 19):
                keys, doc = _grams(data, at[i : j + 1])
                keys |= doc.astype(np.uint64) << np.uint64(8 * ORDER)
                for k in range(ORDER, 0, -1):
                    # each document's n-grams once; shorter ones are ends of these
                    low = np.uint64(8 * ORDER)
                    keys = np.sort(keys >> low << low | keys & np.uint64((1 << 8 * k) - 1))
                    keys = keys[np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))]
                    sums.append((_end(keys, k) | tag[i:j][(keys >> low).astype(np.int64)], np.ones(len(keys), np.int64)))
                if sum(len(t) for t, _ in sums[1:]) > max(MOST, len(sums[0][0])):
                    sums = [_counted(sums)]
                    if len(sums[0][0]) > 2 * MOST:
                        yield _batch(*sums.pop())
                        sums = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        yield _batch(*_counted(sums))

    return rows.mapInArrow(lean(count), "tagged long, n long").groupBy("tagged").agg(F.sum("n").alias("n"))


def _batch(tags: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(tags.view(np.int64)), pa.array(n)], names=["tagged", "n"])


def levels(counts: DataFrame, variants: list[tuple[int, int | None, float]], folder: str) -> DataFrame:
    """The models of ``Model``, orders above ``LOW`` one by one on the cluster: (model, gram, pooled, ratio, less), with ``less`` the ratio of its end.

    ``counts`` has (gram, t, o), documents of either class by fold; ``variants`` are (model, fold left out or None, share of toxic rows).
    """

    def total(c: str, without: int | None):
        return sum((F.col(c)[f] for f in range(FOLDS) if f != without), F.lit(0)).cast("double")

    each = counts.select("gram", F.explode(F.array(*[F.struct(F.lit(m).alias("model"), total("t", f).alias("t"), total("o", f).alias("o"), F.lit(float(share)).alias("share")) for m, f, share in variants])).alias("c"))
    each = each.select("c.model", "gram", "c.t", "c.o", "c.share").where("t + o > 0")

    def end(k: int):
        return F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1)).bitwiseOR(F.lit(k << _BITS))

    def of(k: int) -> DataFrame:
        return each.where(F.shiftright("gram", _BITS) == k)

    context = Window.partitionBy("model", F.shiftright("gram", 8))

    def discounted(c: str, base):
        t, d = F.col(f"{c}_sum"), F.col(f"{c}_some")
        left = F.when(t > 0, DISCOUNT * d / F.greatest(t, F.lit(1.0))).otherwise(1.0)
        return F.log(F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.greatest(t, F.lit(1.0)) + left * F.exp(base))

    # of short n-grams there are few: the driver takes their counts
    low = counts.where(F.shiftright("gram", _BITS) <= LOW).orderBy("gram").toArrow()
    gram, t, o = low.column("gram").to_numpy().view(np.uint64), *(low.column(c).combine_chunks().flatten().to_numpy().reshape(-1, FOLDS).astype(float) for c in "to")
    longer = of(LOW + 1).groupBy("model", end(LOW).alias("gram")).agg(F.count("*").alias("n")).orderBy("model", "gram").toArrow()
    parts = []
    for m, f, share in variants:
        own_t, own_o = (c.sum(1) - (0 if f is None else c[:, f]) for c in (t, o))
        some = own_t + own_o > 0
        many = longer.column("n").to_numpy()[longer.column("model").to_numpy() == m].astype(float)
        got = _orders(gram[some], own_t[some], own_o[some], share, LOW, many)
        parts.append(pa.table([pa.array(np.full(some.sum(), m, np.int32)), pa.array(gram[some].view(np.int64)), pa.array(np.full(some.sum(), share)), *map(pa.array, got)], names=["model", "gram", "share", "pooled", "ratio", "less"]))
    done = [saved(counts.sparkSession.createDataFrame(pa.concat_tables(parts)), f"{folder}/low")]
    for k in range(LOW + 1, ORDER + 1):
        own = of(k)
        if k < ORDER:
            longer = of(k + 1).groupBy("model", end(k).alias("gram")).agg(F.count("*").cast("double").alias("longer"))
            own = own.join(longer, ["model", "gram"])
        else:
            own = own.withColumn("longer", F.col("t") + F.col("o"))
        lower = done[-1].select("model", F.col("gram").alias("end"), F.col("pooled").alias("base"), F.col("ratio").alias("less"))
        own = own.withColumn("end", end(k - 1)).join(lower, ["model", "end"]).drop("end")
        own = own.withColumns({f"{c}_{name}": F.sum(x).over(context) for c in ("longer", "t", "o") for name, x in (("sum", F.col(c)), ("some", (F.col(c) > 0).cast("double")))})
        own = own.withColumn("base_o", F.col("base") - F.log(F.col("share") * F.exp("less") + 1 - F.col("share")))
        own = own.withColumn("step", discounted("t", F.col("base_o") + F.col("less")) - discounted("o", F.col("base_o")) - F.col("less"))
        error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("o") + 0.5))
        ratio = F.greatest(F.lit(LEAST), F.col("less") + F.signum("step") * F.greatest(F.lit(0.0), F.abs("step") - CAUTION * error))
        done.append(saved(own.select("model", "gram", "share", discounted("longer", F.col("base")).alias("pooled"), ratio.alias("ratio"), "less"), f"{folder}/order{k}"))
    out = done[0]
    for one in done[1:]:
        out = out.unionByName(one)
    return out


def _ratios(found: DataFrame) -> dict[int, Model]:
    """For each model, one of n-grams that have another ratio than their ends: all that evidence needs."""
    rows = found.where("ratio <> less").select("model", "gram", "ratio").toArrow()
    own, gram, ratio = (rows.column(c).to_numpy() for c in ("model", "gram", "ratio"))
    return {m: Model.of(gram[own == m].view(np.uint64), ratio[own == m], np.zeros((own == m).sum()), 0.0) for m in np.unique(own).tolist()}


def fit(chosen: DataFrame, toxic_share: float = 0.5, likelihoods: bool = True) -> Model | None:
    """Fit on materialised rows (text, toxic 0/1, fold); None if a class has no rows.

    The curve is fitted on evidence that each of ``FOLDS`` folds gets from the others'
    counts, so that training texts do not vouch for themselves.  Without ``likelihoods``
    the model is good for evidence alone, and smaller.
    """
    folder = shared_dir(chosen.sparkSession)
    tag = F.shiftright("tagged", 56)
    counts = count_grams(chosen.select("text", "toxic", "fold")).groupBy(F.col("tagged").bitwiseAND(F.lit(2**56 - 1)).alias("gram"))
    counts = counts.agg(*[F.array(*[F.sum(F.when(tag == 2 * f + y, F.col("n")).otherwise(0)) for f in range(FOLDS)]).alias(c) for y, c in ((1, "t"), (0, "o"))])
    counts = saved(counts, f"{folder}/counts")
    some = counts.agg(*[F.max(F.col(c)[f] > 0) for c in "to" for f in range(FOLDS)]).head()
    toxic, ordinary = some[:FOLDS], some[FOLDS:]
    if not any(toxic) or not any(ordinary):
        return None
    rows = {(r["fold"], r["toxic"]): r["count"] for r in chosen.groupBy("fold", "toxic").count().collect()}

    def share(without: int | None) -> float:
        t, o = (sum(c for (f, y), c in rows.items() if y == want and f != without) for want in (1, 0))
        return t / (t + o)

    folds = [f for f in range(FOLDS) if all(any(x for g, x in enumerate(have) if g != f) for have in (toxic, ordinary))]
    found = levels(counts, [(f, f, share(f)) for f in folds] + [(FOLDS, None, share(None))], folder)
    models = _ratios(found)
    nothing = Model.of(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), 0.0)
    whole = models.get(FOLDS, nothing)
    parts = chosen.sparkSession.sparkContext.broadcast([models.get(f, nothing) if f in folds else whole for f in range(FOLDS)])
    seen = saved(_evidence(chosen, parts), f"{folder}/evidence")
    parts.unpersist()
    spread = seen.agg(F.stddev_pop("evidence")).head()[0] or 1.0
    width = 2.0 ** np.floor(np.log2(spread)) / BUCKETS  # a mean for each such width and class reaches the driver
    means = seen.groupBy("toxic", F.floor(F.col("evidence") / float(width))).agg(F.count("*").alias("n"), F.avg("evidence").alias("mean")).toArrow()
    if likelihoods:
        log_o = F.col("pooled") - F.log(F.col("share") * F.exp("ratio") + 1 - F.col("share"))
        every = found.where(F.col("model") == FOLDS).select("gram", (log_o + F.col("ratio")).alias("toxic"), log_o.alias("ordinary")).toArrow()  # a row for each distinct n-gram
        whole = Model.of(every.column("gram").to_numpy().view(np.uint64), every.column("toxic").to_numpy(), every.column("ordinary").to_numpy(), _UNKNOWN)
    whole.calibrate(*(means.column(c).to_numpy() for c in ("mean", "toxic", "n")), spread, toxic_share)
    return whole


def _evidence(rows: DataFrame, models) -> DataFrame:
    """Evidence of rows (text, toxic, fold), each from the model that lacks its fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column(2).to_numpy()
            for f in np.unique(fold).tolist():
                own = pa.array(np.flatnonzero(fold == f))
                for i, e in models.value[f].evidence(b.column(0).take(own)):
                    yield pa.RecordBatch.from_arrays([b.column(1).take(own).slice(i, len(e)), pa.array(e)], names=["toxic", "evidence"])

    return rows.select("text", "toxic", "fold").mapInArrow(lean(run), "toxic int, evidence double")


def score_toxicity(df: DataFrame, model: Model | None, columns: list[str], text: str = "text") -> DataFrame:
    """``columns`` of every row, with ``score``, ``predicted`` and the two log-likelihoods a byte."""
    if model is None:
        return df.select(*columns).withColumns({"score": F.lit(0.0), "predicted": F.lit(0), "toxic_ll": F.lit(0.0), "ordinary_ll": F.lit(0.0)})
    sent = df.sparkSession.sparkContext.broadcast(model)
    kept = df.select(F.col(text).alias("_text_"), *columns)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            empty = np.diff(buffers(b.column(0))[1]) == 0
            for i, toxic, ordinary in sent.value.likelihoods(b.column(0)):
                p = sent.value.score(toxic - ordinary, empty[i : i + len(toxic)])
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(k).slice(i, len(p)) for k in range(1, b.num_columns)), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), pa.array(toxic), pa.array(ordinary)],
                    names=[*b.schema.names[1:], "score", "predicted", "toxic_ll", "ordinary_ll"],
                )

    return kept.mapInArrow(lean(run), f"{schema}, score double, predicted int, toxic_ll double, ordinary_ll double")


def filter_toxic(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model does not call toxic."""
    if model is None:
        return df
    sent, at = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            empty, keep = np.diff(buffers(b.column(at))[1]) == 0, np.ones(b.num_rows, bool)
            for i, e in sent.value.evidence(b.column(at)):
                keep[i : i + len(e)] = sent.value.score(e, empty[i : i + len(e)]) < 0.5
            yield b.filter(pa.array(keep))

    return df.mapInArrow(lean(run), df.schema)


def held_out(key: str = "doc_id", folds: int = 5):
    """Column: whether a document is kept out of fitting."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", likelihoods: bool = True) -> Model | None:
    """Fit on all labelled documents that are not held out."""
    marked = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("toxic")).where(~held_out("id"))
    n = {r[0]: r[1] for r in marked.groupBy("toxic").count().collect()}
    # one text hash for each id first, so that only these texts move
    rows = documents.select(F.col(key).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    one = rows.select("id", "h").join(marked, "id").groupBy("id").agg(F.min("h").alias("h"), F.max("toxic").cast("int").alias("toxic"))
    one = one.withColumn("fold", F.pmod(F.xxhash64("id", "h"), F.lit(FOLDS)).cast("int"))
    # rows of one fold and class lie together, so that a task counts few n-grams of many kinds
    order = ["fold", "toxic", "h", "id"]
    texts = rows.join(one, ["id", "h"]).repartitionByRange(*order).dropDuplicates(order).select("text", "toxic", "fold")
    return fit(saved(texts, shared_dir(documents.sparkSession)), n.get(1, 0) / max(1, sum(n.values())), likelihoods)
