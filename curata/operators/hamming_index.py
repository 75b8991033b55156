"""Exact pairs of 64-bit hashes within a Hamming distance, by indexes whose candidates follow the answer.

Small distances: of b bands of two hashes within k bits one differs by k // b bits at most, so equal bands are joined after
one side is spread over the neighbours of its bands.

Larger distances: a metric index. Pivots are chosen farthest first; each hash is homed in a ring of its nearest pivot's
cell, and visits the rings that the triangle inequality leaves: two hashes within k bits differ by k at most in their
distances to any pivot, and if one is nearest to pivot p the other is at most 2 k farther from p than from its own. Hashes
that lie in families meet their own neighbourhood only.

Hashes spread evenly over all 64 bits have no neighbourhood at 19 bits or more, and all rings would meet, a row for each
hash and ring. Where a sample of hashes visits too much, all pairs are compared instead, in square blocks of bounded size
that any number of tasks share: each task has two blocks as arrays and gives only what is near.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb, isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.plans.scratch import Scratch

#: Neighbours of a band that a hash is looked up by at most, over all bands, and share of all pairs that bands may select.
MOST_PROBES, MOST_SELECTED = 1200, 0.05
#: Pivots at most, hashes that they are chosen among (any choice gives the same pairs), width of a ring, and hashes of a part.
PIVOTS, SAMPLE, RING, PART = 1024, 1 << 14, 8, 4096
RINGS = 64 // RING + 1
#: Hashes of a block, blocks at least, pairs of hashes compared at a time, and share of all pairs that rings may meet.
BLOCK, BLOCKS, AT_ONCE, MOST_MET = 1 << 15, 16, 1 << 18, 0.02


def _spread(width: int, flips: int) -> int:
    return sum(comb(width, r) for r in range(flips + 1))


def bands_for(bits: int) -> int | None:
    """The number of bands with the fewest probes that select few enough pairs, or None."""
    best = None
    for count in range(1, 65):
        width = 64 // count
        probes = count * _spread(width + (64 % count > 0), bits // count)
        if probes <= (best[0] if best else MOST_PROBES) and probes <= MOST_SELECTED * 2**width:
            best = (probes, count)
    return best[1] if best else None


def _flipped(part: Column, k: int, masks: list[int]) -> Column:
    return F.transform(F.array(*[F.lit(m).cast("bigint") for m in masks]), lambda m: F.struct(F.lit(k).alias("k"), part.bitwiseXOR(m).alias("v")))


def _banded(reps: DataFrame, bits: int, count: int) -> DataFrame:
    cuts = [64 * k // count for k in range(count + 1)]
    spans = list(zip(cuts[:-1], cuts[1:], strict=True))

    def keys(flips: int) -> Column:
        out = []
        for k, (lo, hi) in enumerate(spans):
            own = F.shiftrightunsigned("phash", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 64 else -1))
            masks = [sum(1 << i for i in c) for r in range(flips + 1) for c in combinations(range(hi - lo), r)]
            signed = [m - (1 << 64) if m >> 63 else m for m in masks]
            out.append(_flipped(own, k, signed))
        return F.explode(F.flatten(F.array(*out)))

    a, b = reps.withColumn("band", keys(0)).alias("a"), reps.withColumn("band", keys(bits // count)).alias("b")
    # Spark sizes the spread side as if each hash were one row and would broadcast it: it is to be shuffled whatever its size
    return a.hint("merge").join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.phash") < F.col("b.phash")))


def farthest_first(sample: np.ndarray, most: int, reach: int) -> np.ndarray:
    """Up to so many of the hashes, each the farthest from those before, until all lie within reach of one."""
    picked = [0]
    near = np.bitwise_count(sample ^ sample[0])
    while len(picked) < most and near.max() > reach:
        picked.append(int(near.argmax()))
        near = np.minimum(near, np.bitwise_count(sample ^ sample[picked[-1]]))
    return sample[picked]


def _ringed(reps: DataFrame, bits: int, most: float = 1.0) -> DataFrame | None:
    """Pairs of rings that may be near; None if a sample of the hashes would meet more than that share of all."""
    work = Scratch(reps.sparkSession, "rings")
    sample = reps.select("phash").orderBy(F.xxhash64("phash"), "phash").limit(SAMPLE).toPandas()["phash"].to_numpy(np.int64).view(np.uint64)
    if not len(sample):
        return reps.alias("a").join(reps.alias("b"), (F.col("a.phash") < F.col("b.phash")) & (F.col("a.phash") == F.col("b.phash")))
    pivots = farthest_first(sample, min(PIVOTS, 4 * isqrt(len(sample)) + 1), bits // 2)

    def distances(batch: pa.RecordBatch):
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            yield part, np.bitwise_count(part.column(0).to_numpy().view(np.uint64)[:, None] ^ pivots).astype(np.int16)

    def settle(batches):
        for batch in batches:
            for part, d in distances(batch):
                cell = d.argmin(axis=1)
                own = d[np.arange(len(d)), cell]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell * RINGS + own // RING, pa.int32()), pa.array(own, pa.int32())], ["phash", "p", "ring", "d"])

    kind = reps.schema["p"].dataType.simpleString()
    home = work.table(reps.select("phash", "p").mapInArrow(settle, f"phash bigint, p {kind}, ring int, d int"), "home")
    # a row for each ring that has hashes: RINGS times PIVOTS at most
    rings = home.groupBy("ring").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count(F.lit(1)).alias("n")).orderBy("ring").toPandas()
    ring, low, high, held = (rings[c].to_numpy(np.int64) for c in ("ring", "low", "high", "n"))
    cell, parts = ring // RINGS, -(-held // PART)
    if most < 1:
        d = np.bitwise_count(sample[:1024, None] ^ pivots).astype(np.int16)
        to = d[:, cell]
        if (((to <= high + bits) & (to >= low - bits) & (to <= d.min(axis=1)[:, None] + 2 * bits)) @ held).mean() > most * held.sum():
            work.drop("")
            return None

    def visits(batches):
        for batch in batches:
            for part, d in distances(batch):
                to, own = d[:, cell], part.column(3).to_numpy()[:, None]
                ok = (to <= high + bits) & (to >= low - bits) & (to <= own + 2 * bits) & (ring >= part.column(2).to_numpy()[:, None])
                row, at = np.nonzero(ok)
                n = parts[at]
                sub = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row, at = np.repeat(row, n), np.repeat(at, n)
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(row)) for k in range(3)], pa.array(ring[at], pa.int32()), pa.array(sub, pa.int32()), pa.array(to[row, at], pa.int32())], ["phash", "p", "own", "ring", "sub", "d"])

    def members(batches):
        for batch in batches:
            n = parts[np.searchsorted(ring, batch.column(2).to_numpy())].astype(np.uint64)
            sub = (batch.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sub.astype(np.int32))], ["phash", "p", "ring", "d", "sub"])

    a = home.mapInArrow(visits, f"phash bigint, p {kind}, own int, ring int, sub int, d int").alias("a")
    b = home.mapInArrow(members, f"phash bigint, p {kind}, ring int, d int, sub int").alias("b")
    once = (F.col("a.own") < F.col("a.ring")) | (F.col("a.phash") < F.col("b.phash"))
    return a.join(b, (F.col("a.ring") == F.col("b.ring")) & (F.col("a.sub") == F.col("b.sub")) & once & (F.abs(F.col("a.d") - F.col("b.d")) <= bits))


def _near(x: np.ndarray, y: np.ndarray, bits: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, rows of y, distances) of all pairs within so many bits, a part of them at a time; of a block with itself each pair once."""
    step = max(1, AT_ONCE // max(1, len(y)))
    held, size = [], 0
    for a in range(0, len(x), step):
        apart = np.bitwise_count(x[a : a + step, None] ^ y).ravel()
        found = np.flatnonzero(apart <= bits)
        if not len(found):
            continue
        i, j, d = found // len(y) + a, found % len(y), apart[found].astype(np.int32)
        held.append(tuple(v[i < j] for v in (i, j, d)) if same else (i, j, d))
        size += len(held[-1][0])
        if size >= AT_ONCE // 4:
            yield tuple(np.concatenate(v) for v in zip(*held, strict=True))
            held, size = [], 0
    if held:
        yield tuple(np.concatenate(v) for v in zip(*held, strict=True))


Met = Callable[[pa.Table, pa.Table, bool], Iterator[pa.RecordBatch]]


def _met(reps: DataFrame, meet: Met, schema: str) -> DataFrame:
    """meet(rows, rows, same) for each pair of blocks of the rows (phash first), each pair of blocks in one task."""
    count = reps.count()
    blocks = max(-(-count // BLOCK), min(BLOCKS, -(-count // 1024)), 1)
    k, block = F.col("k"), F.pmod(F.xxhash64("phash"), F.lit(blocks)).cast("int")
    low, high = F.least("block", k), F.greatest("block", k)
    # pairs of blocks are numbered as the lower triangle; a block's own pair has its rows once
    dealt = reps.withColumn("block", block).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select((high * (high + 1) / 2 + low).cast("int").alias("task"), (F.col("block") == low).alias("first"), (low == high).alias("same"), *reps.columns)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            same, first = rows["same"][0].as_py(), rows["first"]
            own = rows.drop_columns(["task", "first", "same"])
            x = own.filter(first)
            yield from meet(x, x if same else own.filter(pc.invert(first)), same)

    return dealt.repartitionById(blocks * (blocks + 1) // 2, "task").mapInArrow(whole, schema)


def _hashes(rows: pa.Table) -> np.ndarray:
    return rows["phash"].to_numpy().view(np.uint64)


def _all_pairs(reps: DataFrame, bits: int) -> DataFrame:
    def meet(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, apart in _near(_hashes(x), _hashes(y), bits, same):
            ends = [t[c].take(pa.array(at)).combine_chunks() for t, at in ((x, i), (y, j)) for c in ("phash", "p")]
            yield pa.RecordBatch.from_arrays([*ends, pa.array(apart)], ["h1", "p1", "h2", "p2", "bits"])

    kind = reps.schema["p"].dataType.simpleString()
    found = _met(reps.select("phash", "p"), meet, f"h1 bigint, p1 {kind}, h2 bigint, p2 {kind}, bits int")
    turned = F.col("p1") > F.col("p2")
    return found.select(*[F.when(turned, F.col(f"{n}{3 - k}")).otherwise(F.col(f"{n}{k}")).alias(f"{n}{k}") for k in (1, 2) for n in "hp"], "bits")


def _joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The labels, of which each component has its smallest place, once these links are added."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return label
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label = up


def _all_links(reps: DataFrame, bits: int) -> DataFrame:
    def meet(x: pa.Table, y: pa.Table, same: bool) -> Iterator[pa.RecordBatch]:
        hx, hy, cx, cy = _hashes(x), _hashes(y), x["c"].to_numpy(), y["c"].to_numpy()
        beside = 0 if same else len(hx)
        nodes = hx if same else np.concatenate([hx, hy])
        label, total, n = np.arange(len(nodes)), np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
        for i, j, apart in _near(hx, hy, bits, same):
            pairs = cx[i] * cy[j]
            np.add.at(total, i, apart * pairs)
            np.add.at(n, i, pairs)
            label = _joined(label, i, j + beside)
        told = np.flatnonzero((n > 0) | (label != np.arange(len(nodes))))
        values = [pa.array(v) for v in (nodes[told].view(np.int64), nodes[label[told]].view(np.int64), total[told], n[told])]
        yield pa.RecordBatch.from_arrays(values, ["phash", "other", "bits", "n"])

    return _met(reps.select("phash", F.col("c").cast("bigint").alias("c")), meet, "phash bigint, other bigint, bits bigint, n bigint")


def _few_met(reps: DataFrame, bits: int) -> DataFrame | None:
    """Candidates from bands or rings, or None where neither leaves few enough."""
    count = bands_for(bits)
    return _banded(reps, bits, count) if count else _ringed(reps, bits, MOST_MET)


def candidates(reps: DataFrame, bits: int) -> DataFrame:
    """Pairs (a.phash, a.p, b.phash, b.p) of distinct hashes that hold all those within so many bits, some repeatedly."""
    count = bands_for(bits)
    return _banded(reps, bits, count) if count else _ringed(reps, bits)


def pairs_within(reps: DataFrame, bits: int) -> DataFrame:
    """(h1, p1, h2, p2, bits) of all pairs p1 < p2 of rows (phash bigint, p) with distinct hashes within so many bits.

    Rows with a null hash have no pair. Each pair comes once.
    """
    known = reps.select("phash", "p").filter("phash is not null")
    met = _few_met(known, bits)
    return _all_pairs(known, bits) if met is None else _within(met, bits)


def _within(met: DataFrame, bits: int) -> DataFrame:
    apart = F.bit_count(F.col("a.phash").bitwiseXOR(F.col("b.phash")))
    turned = F.col("a.p") > F.col("b.p")
    ends = [F.when(turned, F.col(f"{y}.{c}")).otherwise(F.col(f"{x}.{c}")).alias(f"{n}{k}") for k, (x, y) in ((1, "ab"), (2, "ba")) for n, c in (("h", "phash"), ("p", "p"))]
    return met.filter(apart <= bits).select(*ends, apart.alias("bits")).distinct()


def links_within(reps: DataFrame, bits: int) -> DataFrame:
    """(phash, other, bits, n): links that connect what the pairs within so many bits of rows (phash bigint, c) connect, and no more.

    A link to itself connects nothing. Over all rows of a component, n is the sum of the products of its pairs' counts c,
    and bits that of these products times the distances. Where all pairs are compared, a block's pairs are summed up in
    its task: there are no rows for pairs.
    """
    known = reps.select("phash", F.col("c").cast("bigint").alias("p")).filter("phash is not null")
    met = _few_met(known, bits)
    if met is None:
        return _all_links(reps.filter("phash is not null"), bits)
    product = F.col("p1") * F.col("p2")
    return _within(met, bits).select(F.col("h1").alias("phash"), F.col("h2").alias("other"), (F.col("bits") * product).alias("bits"), product.alias("n"))
