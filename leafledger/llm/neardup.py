"""MinHash near-duplicate detection with SuperMinHash signatures.

1.  Texts -> distinct k-word shingles (64-bit hashes) -> SuperMinHash signature.  Every
    element walks a random permutation of the ``m`` registers; layer j offers the value
    ``j + r`` to the j-th register of its walk.  All values of layer j are below those
    of later layers, so a document stops at the first layer after which all registers
    hold a value: long texts need one or two layers, short ones more.
2.  Documents with equal shingle sets (a 128-bit digest of the sorted set) are one
    class; only its smallest id goes on.
3.  ``bands`` bands of ``rows`` registers; every member of a bucket is tied to the
    bucket's smallest id, and union-find over these ties gives candidate groups.  No
    pairs are made.
4.  Shingle sets of candidates only are made again (they are chosen by a bitmap with 16
    bits a candidate, or by a join if that had more than 64 MB, and by an exact join) and
    dealt by group.  A group of over ``block`` classes is dealt to blocks by hash, and
    blocks are compared in pairs; one of over ``fan_out`` blocks is compared within its
    blocks, all of which also get a few pivot rows of the group.  Pairs that share a band
    and are not yet known to be connected are confirmed on the full sets by exact
    intersection counts, and a spanning forest of the confirmed links is returned.
5.  Union-find over the confirmed links gives components.  Where a group of over
    ``fan_out`` blocks is not one component yet, its rows are dealt once more, components
    to blocks of their own, and only blocks of different components are compared: work
    grows with what is not connected, not with the square of a group of copies.
6.  Union-find over all links gives the result.

With 25 bands of 5 registers a pair at similarity 0.85 shares no band with probability
4e-7, at 0.8 with 5e-5.

Null and empty texts, and texts of white space, have no shingles and no links.  With
fewer words than ``k`` the whole sequence is the one shingle.  A null id is kept, has a
null component and takes no part.  Rows with equal ids count as one document for linking,
which has the links of all their texts, and stay separate rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import UnionFind, components, local_forest
from . import store
from .store import bits_for, in_bitmap, key_bitmap, saved, shared_dir
from .text import Words, buffers, lean, mix, shingles, slices

BANDS, ROWS = 25, 5
FAN_OUT, PIVOTS = 32, 8
_M = BANDS * ROWS
_EMPTY = np.uint64(2**63)


def _draw(h: np.ndarray, layer: int) -> np.ndarray:
    """64 random bits of each element for a layer."""
    return mix(h + np.uint64((layer + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))


def superminhash(h: np.ndarray, at: np.ndarray, m: int = _M) -> np.ndarray:
    """Signatures (documents x m, uint32) of sets ``h[at[i]:at[i + 1]]``; empty sets get zeros.

    A register's value is ``j * 2**24 + r`` for layer j and 24 random bits r.
    """
    n = len(at) - 1
    sig = np.full((n, m), _EMPTY, np.uint64)
    if not len(h):
        return np.zeros((n, m), np.uint32)
    doc = np.repeat(np.arange(n), np.diff(at))
    flat = sig.reshape(-1)
    perm, el = None, np.arange(len(h))
    for j in range(m):
        bits = _draw(h[el], j)
        k = (j + (((bits >> np.uint64(40)) * np.uint64(m - j)) >> np.uint64(24)).astype(np.int64)).astype(np.int64)
        value = (bits & np.uint64(0xFFFFFF)) | np.uint64(j << 24)
        if j == 0:
            place = k
        else:
            rows = np.arange(len(el))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[rows, j]
        np.minimum.at(flat, doc[el] * m + place, value)
        open_ = (sig == _EMPTY).any(1)
        if j == 0:
            first, el = place, np.flatnonzero(open_[doc])
            if len(el):
                perm = np.tile(np.arange(m, dtype=np.uint8), (len(el), 1))
                rows = np.arange(len(el))
                perm[rows, first[el]] = 0  # the swap of the first step: register 0 now stands where k was
        else:
            keep = open_[doc[el]]
            if not keep.all():
                el, perm = el[keep], perm[keep]
        if not len(el):
            break
    sig[sig == _EMPTY] = 0
    return sig.astype(np.uint32)


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(documents x bands) signed 64-bit keys."""
    out = np.zeros((len(sig), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sig), b + 1, np.uint64)
        for r in range(rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * rows + r].astype(np.uint64))
        out[:, b] = key
    return out.view(np.int64)


_SIGNED = "key long, n_shingles long, set binary, bands array<long>"


def _sets(column: pa.Array, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    data, at = buffers(column)
    for i, j in slices(at, 1 << 19):
        yield i, *shingles(Words(data, at[i : j + 1]), k)


def signatures(rows: DataFrame, k: int) -> DataFrame:
    """key, n_shingles, digest of the set, band keys (none for an empty set)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, h, at in _sets(b.column(1), k):
                n = np.diff(at)
                full = np.flatnonzero(n)
                view = memoryview(h).cast("B")
                digests = [_set_digest(view[8 * a : 8 * z]) if z > a else None for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                keys = band_keys(superminhash(h, at))[full]
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(n > 0, BANDS, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, len(n)), pa.array(n), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel()))],
                    names=["key", "n_shingles", "set", "bands"],
                )

    return rows.mapInArrow(lean(sign), _SIGNED)


def candidate_sets(rows: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """(shingles, bands, and the columns of ``wanted``) of rows with a (key, set) of ``wanted``; repeated rows may come several times."""
    n = wanted.count()
    if 16 * n <= store.MOST_BITS:
        bitmap = rows.sparkSession.sparkContext.broadcast(key_bitmap(wanted, "key", bits_for(n)))
        some = rows.where("key is not null")
    else:  # too many for a bitmap: every text that may be one moves once
        bitmap, some = None, rows.join(wanted.select("key").distinct(), "key", "left_semi")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, bytes]] = set()
        for b in batches:
            keys = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            maybe = np.flatnonzero(in_bitmap(bitmap.value, keys)) if bitmap else np.arange(len(keys))
            column = b.column(1).take(pa.array(maybe))
            for i, h, at in _sets(column, k):
                sig, view, own = band_keys(superminhash(h, at)), memoryview(h).cast("B"), keys[maybe[i : i + len(at) - 1]].tolist()
                sets = [view[8 * a : 8 * z] for a, z in zip(at[:-1].tolist(), at[1:].tolist())]
                digests, out = [_set_digest(x) for x in sets], []
                for j, one in enumerate(zip(own, digests)):
                    if len(sets[j]) and one not in sent:  # repeated rows of a task go no further
                        if len(sent) >= 200_000:
                            sent.clear()
                        sent.add(one)
                        out.append(j)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([own[j] for j in out], pa.int64()), pa.array([digests[j] for j in out], pa.binary()), pa.array([sets[j] for j in out], pa.binary()), pa.array([sig[j].tobytes() for j in out], pa.binary())],
                    names=["key", "set", "shingles", "bands"],
                )

    return some.mapInArrow(lean(pick), "key long, set binary, shingles binary, bands binary").join(wanted, ["key", "set"])


def _set_digest(shingle_bytes) -> bytes:
    return hashlib.blake2b(shingle_bytes, digest_size=16).digest()


def confirm(ids: np.ndarray, sets: list[np.ndarray], bands: np.ndarray, side: np.ndarray, known: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among members of one block or pair of blocks.

    Only pairs that share a band and are of different ``known`` components are looked at,
    and within two different blocks (``side`` tells them apart) only those across.  A
    link: 100 * intersection >= percent * union.
    """
    n, size = len(ids), np.array([len(s) for s in sets])
    joined = UnionFind(n)
    _, first, of = np.unique(known, return_index=True, return_inverse=True)
    for x, y in enumerate(first[of].tolist()):
        joined.join(x, y)
    if n <= 32:
        share = (bands[:, None, :] == bands[None, :, :]).any(2)
    else:
        share = np.zeros((n, n), bool)
        for b in range(bands.shape[1]):
            share |= bands[:, b, None] == bands[None, :, b]
    share &= np.arange(n)[:, None] < np.arange(n)[None, :]
    share &= of[:, None] != of[None, :]
    if side.any() and not side.all():
        share &= side[:, None] != side[None, :]
    # a link needs 100 * smaller >= percent * larger
    share &= 100 * np.minimum(size[:, None], size[None, :]) >= percent * np.maximum(size[:, None], size[None, :])
    a, b = np.nonzero(share)
    if not len(a):
        return []
    out = []
    if n <= 6:
        for x, y in zip(a.tolist(), b.tolist()):
            if joined.root(x) != joined.root(y):
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (size[x] + size[y] - both) and joined.join(x, y):
                    out.append((int(ids[x]), int(ids[y])))
        return out
    owner = np.repeat(np.arange(n), size)
    words, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    rank = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], rank[place[keep]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    both, wide = np.zeros((n, n), np.float32), 4096
    for lo in range(0, int(often.sum()), wide):
        p, q = np.searchsorted(place, (lo, lo + wide))
        x = np.zeros((n, wide), np.float32)
        x[owner[p:q], place[p:q] - lo] = 1
        both += x @ x.T
    common = both[a, b].astype(np.int64)
    linked = np.flatnonzero(100 * common >= percent * (size[a] + size[b] - common))
    for x, y in zip(a[linked].tolist(), b[linked].tolist()):
        if joined.join(x, y):
            out.append((int(ids[x]), int(ids[y])))
    return out


def checked(dealt: DataFrame, percent: int) -> DataFrame:
    """(src, dst) links confirmed in each block: rows of group, part, side, key, known, set, shingles, bands."""
    dealt = dealt.select("group", "part", "key", "set", "side", "known", "shingles", "bands").repartition("group", "part").sortWithinPartitions("group", "part", "key", "set")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, [], []

        def close() -> None:
            if len(held) > 1:
                ids, known = (np.array([r[c] for r in held], np.int64) for c in (2, 5))
                sets, bands = [np.frombuffer(r[6], np.uint64) for r in held], np.stack([np.frombuffer(r[7], np.int64) for r in held])
                out.extend(confirm(ids, sets, bands, np.array([r[4] for r in held]), known, percent))

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for row in zip(*(c.to_pylist() for c in part.columns)):
                    if row[:2] != now:
                        close()
                        now, held = row[:2], []
                    if not held or row[2:4] != held[-1][2:4]:  # a repeated row
                        held.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["src", "dst"])
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["src", "dst"])

    return dealt.mapInArrow(lean(check), "src long, dst long").where("src <> dst")


def _hashed(n, *salt):
    return F.pmod(F.xxhash64(*salt, "key", "set"), F.greatest(F.lit(1), n)).cast("int")


def first_blocks(members: DataFrame, block: int, fan_out: int) -> DataFrame:
    """Rows (with ``members``, the size of their group) dealt to blocks of about ``block``.

    In groups of up to ``fan_out`` blocks each row goes to all pairs of its block and
    another.  In larger ones it goes to its block, and about ``PIVOTS`` rows of the group,
    chosen by hash, to all blocks, so that blocks of one group of copies get linked.
    """
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / block)).cast("int")
    pivot = F.pmod(F.xxhash64(F.lit("pivot"), "key", "set"), F.col("members")) < PIVOTS
    rows = members.withColumns({"own": _hashed(F.ceil(F.col("members") / block)), "known": F.monotonically_increasing_id()})
    all_ = F.sequence(F.lit(0), blocks - 1)
    rows = rows.withColumn("other", F.explode(F.when((blocks <= fan_out) | pivot, all_).otherwise(F.array("own"))))
    pair = F.concat(F.least("own", "other").cast("string"), F.lit("|"), F.greatest("own", "other").cast("string"))
    return rows.withColumns({"part": F.when(blocks <= fan_out, pair).otherwise(F.col("other").cast("string")), "side": (blocks > fan_out) | (F.col("own") <= F.col("other"))})


def across_components(members: DataFrame, block: int) -> DataFrame:
    """Rows (with ``known``, their component) dealt to pairs of blocks of different components of their group.

    A component of more than ``block`` rows has blocks of its own; the small ones of a
    group share blocks, whole, and are compared within these as well.
    """
    sizes = members.groupBy("group", "known").agg(F.count("*").alias("n"))
    large = sizes.where(F.col("n") > block)
    small = sizes.where(F.col("n") <= block).groupBy("group").agg(F.sum("n").alias("small"))
    # a row for each large component: at most members / block of a group
    lists = large.groupBy("group").agg(F.collect_list(F.struct("known", F.ceil(F.col("n") / block).cast("int").alias("blocks"))).alias("lists"))
    all_ = members.join(large.select("group", "known", F.ceil(F.col("n") / block).cast("int").alias("blocks")), ["group", "known"], "left").join(small, "group", "left").join(lists, "group", "left")
    shared = F.coalesce(F.ceil(F.col("small") / block).cast("int"), F.lit(0))
    name = lambda known, at: F.concat(F.coalesce(known.cast("string"), F.lit("")), F.lit("/"), at.cast("string"))
    is_large = F.col("blocks").isNotNull()
    own = F.when(is_large, name(F.col("known"), _hashed(F.col("blocks")))).otherwise(name(F.lit(None), F.pmod(F.xxhash64("known"), F.greatest(F.lit(1), shared))))
    others = F.filter(F.coalesce("lists", F.array().cast("array<struct<known:bigint,blocks:int>>")), lambda x: ~is_large | (x["known"] != F.col("known")))
    partners = F.flatten(F.transform(others, lambda x: F.transform(F.sequence(F.lit(0), x["blocks"] - 1), lambda i: name(x["known"], i))))
    mixed = F.when(shared > 0, F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), shared - 1)), lambda i: name(F.lit(None), i))).otherwise(F.array().cast("array<string>"))
    dealt = all_.withColumn("own", own).withColumn("other", F.explode(F.concat(partners, mixed)))
    return dealt.withColumns({"part": F.concat(F.least("own", "other"), F.lit("|"), F.greatest("own", "other")), "side": F.col("own") <= F.col("other")})


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80, block: int = 128, fan_out: int = FAN_OUT) -> DataFrame:
    """Per row: key, n_shingles, component_id, kept (the component's smallest id)."""
    folder = shared_dir(df.sparkSession)
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    signed = saved(signatures(rows, k), f"{folder}/signed")
    real = signed.where("set is not null and key is not null")
    # equal sets: one class, whose smallest id stands for it
    classes = real.groupBy("set").agg(F.min("key").alias("rep"))
    first = classes.select("set", F.col("rep").alias("key"))
    chosen = saved(real.join(first, ["key", "set"], "left_semi").select("key", "set", "bands").dropDuplicates(["key", "set"]), f"{folder}/chosen")
    keys = chosen.select("key", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("key").alias("low"), F.count("*").alias("n")).where("n > 1").select("band", "low")
    ties = keys.join(buckets, "band").where("key <> low").select(F.col("key").alias("src"), F.col("low").alias("dst"))
    groups = components(ties)
    member = groups.select(F.col("vertex").alias("key"), F.col("component").alias("group")).unionByName(groups.select(F.col("component").alias("key"), F.col("component").alias("group")).distinct())
    member = saved(chosen.select("key", "set").join(member, "key"), f"{folder}/member")
    sizes = member.groupBy("group").agg(F.count("*").alias("members")).where(F.col("members") > block)
    sized = member.join(sizes, "group", "left").withColumn("members", F.coalesce("members", F.lit(1)))
    large = sizes.where(F.col("members") > block * fan_out).select("group")
    # an id with several texts is one document: its classes are linked
    several = real.groupBy("key").agg(F.min("set").alias("a"), F.max("set").alias("b")).where("a <> b").select("key")
    same = real.join(several, "key").select("key", "set").distinct().join(classes, "set").where("key <> rep").select(F.col("key").alias("src"), F.col("rep").alias("dst"))
    links = checked(first_blocks(candidate_sets(rows, k, sized), block, fan_out), percent).unionByName(same)
    found = components(links, contracted=True)
    if not large.isEmpty():
        found = _across(rows, k, percent, block, member.join(large, "group"), found, folder)
    # every class member follows its representative; every document its component
    of_rep = classes.join(found, F.col("rep") == F.col("vertex"), "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    alone = F.concat(F.lit("empty:"), F.coalesce(F.col("key").cast("string"), F.lit(""))).cast("binary")  # texts without shingles do not meet in one task
    out = signed.select("key", "n_shingles", F.coalesce("set", alone).alias("set")).join(of_rep, "set", "left")
    out = out.withColumn("component_id", F.when(F.col("key").isNotNull(), F.coalesce("component_id", "key")))
    return out.select(F.col("key").alias(key), "n_shingles", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept"))


def _across(rows: DataFrame, k: int, percent: int, block: int, large: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """Components after comparing, in groups of several blocks (``large``: group, key, set), those components that differ."""
    known = large.join(found, F.col("key") == F.col("vertex"), "left").select("group", "key", "set", F.coalesce("component", "key").alias("known"))
    split = known.groupBy("group").agg(F.min("known").alias("a"), F.max("known").alias("b")).where("a <> b").select("group")
    open_ = saved(known.join(split, "group"), f"{folder}/open")
    if open_.isEmpty():
        return found
    more = checked(across_components(candidate_sets(rows, k, open_), block), percent)
    old = found.select(F.col("vertex").alias("src"), F.col("component").alias("dst"))
    return components(old.unionByName(more), contracted=True)
