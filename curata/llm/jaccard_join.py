"""Exact n-gram Jaccard join with count-vector R-trees.

Each text becomes the set of its distinct word shingles. The shingles are hashed into groups, the more the larger the
set; the counts per group are a point, and the sum of two points' coordinate minima bounds the overlap of their sets from
above. Points are indexed in packed R-trees whose boxes carry the same bound on COARSE groups (finer counts fold into
coarser ones by addition), leaf pairs are bounded again on all groups, and the pairs that survive are verified on the sets.

One R-tree over all points can't prune: the counts of a random text of n shingles vary by sqrt(n / groups) a group, so
boxes of many texts of like size always meet the bound. By the pigeonhole principle two sets with a Jaccard similarity of
at least t share a shingle among the first n - ceil(t n) + 1 of each, in any global order, so only sets of one such prefix
bucket are compared. Shingles of many documents are ordered last, so popular passages don't fill buckets.

Components need no link between documents that are connected already. So each set is first verified against the hub it
shares most of its prefix with, a set that is likely the original of a family. The buckets that then still hold several
components are brought together by their smallest member, so that a family's many buckets become one or a few trees and a
pair is met once or a few times, and are searched, first for the best partner of each set and then, with what is still
apart, completely.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import Words, blocks, buffers, mix, signed, stream, tidy
from curata.llm.scratch import Scratch, bloom, free_name, small_batches
from curata.operators.components import connected_components

#: Groups of the R-trees' boxes; a set's own vector has a power of two from COARSE to FINE that is its size at least.
COARSE, FINE = 64, 4096
#: Documents from which a shingle counts as common, and how many common shingles are sent to the tasks at most (8 bytes
#: each). Both only change the order of shingles, and any order gives the same result.
COMMON, MAX_COMMON = 8, 1 << 20
#: Postings of one shard, and keys that a task gathers before it cuts them into shards.
SHARD, FLUSH = 1 << 18, 1 << 19
#: Points of one R-tree. Larger groups are searched as pairs of blocks, each pair a task's group of its own.
TREE_POINTS, LEAF = 1024, 16
#: Share (percent) of the smaller prefix that a set has in common with a hub that it is verified against. What this
#: passes over is left to the trees.
LIKELY = 60
MAX_CLASHES = 1000
#: Bytes of texts that are verified side by side; a longer pair is verified alone.
VERIFIED = 1 << 21

_SID = stream(31, 2)


class Sets:
    """Distinct shingles of each row of a block, sorted within the row, with an order-independent 128-bit digest."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, width: int, clashes: np.ndarray | None = None):
        self.words = Words(data, offs)
        raw, first = self.words.shingles(width)
        self.raw = raw
        parts = [np.unique(raw[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.size = np.array([len(p) for p in parts], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.value = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
        digest = []
        for seed in _SID:
            acc = np.zeros(len(self.value) + 1, np.uint64)
            np.cumsum(mix(self.value ^ seed), out=acc[1:])
            digest.append(mix(acc[self.first[1:]] - acc[self.first[:-1]] + self.size.astype(np.uint64)))
        self.sid, self.check = digest
        if clashes is not None and len(clashes):  # ids that two sets share go by their other half
            self.sid = np.where(np.isin(self.sid, clashes), self.check, self.sid)

    def prefix(self, t: int, common: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of each row's first n - ceil(t n / 100) + 1 shingles, common ones ordered last."""
        row = np.repeat(np.arange(len(self.size)), self.size)
        bucket = bucket_of(self.value, shards)
        if len(common):
            order = np.lexsort((_among(bucket, common), row))  # stable: hash order within the two kinds
            bucket = bucket[order]
        keep = prefix_size(self.size, t)
        nth = np.arange(len(bucket)) - self.first[row]
        chosen = nth < keep[row]
        return row[chosen], bucket[chosen]

    def once(self, ids: pa.Array) -> np.ndarray:
        """The first row of each distinct set among the rows with an id: equal sets of a block are posted once."""
        valid = np.flatnonzero(np.asarray(ids.is_valid()))
        out = np.zeros(len(self.sid), bool)
        out[valid[np.unique(self.sid[valid], return_index=True)[1]]] = True
        return out

    def counts(self) -> pa.Array:
        """Group counts of each row as bytes, of as many groups as groups_of says; a count of 255 says 255 or more."""
        wide = groups_of(self.size)
        first = np.concatenate([[0], np.cumsum(wide)])
        row = np.repeat(np.arange(len(self.size)), self.size)
        flat = np.bincount(first[row] + (self.value & (wide[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(first[-1]))
        return pa.Array.from_buffers(pa.binary(), len(wide), [None, pa.py_buffer(first.astype(np.int32)), pa.py_buffer(np.minimum(flat, 255).astype(np.uint8))])


def prefix_size(n: np.ndarray, t: int) -> np.ndarray:
    return n - -(-n * t // 100) + 1


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of a set of n shingles: the power of two from COARSE to FINE that is n at least."""
    return np.clip(1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64), COARSE, FINE)


def bucket_of(value: np.ndarray, shards: int) -> np.ndarray:
    """The bucket of a shingle: its shard above 32 bits of its hash. Two shingles in one bucket cost work and nothing else."""
    shard = (value >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)
    return (shard << np.uint64(32) | value & np.uint64(0xFFFFFFFF)).view(np.int64)


def _among(x: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which of x are among the sorted values."""
    return values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x if len(values) else np.zeros(len(x), bool)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Upper bounds of the overlaps of sets with these count vectors (last axis: groups)."""
    low = np.minimum(a, b)
    total = low.sum(axis=-1, dtype=np.int64)
    full = (low == 65535).any(axis=-1)
    return np.where(full, np.iinfo(np.int64).max, total)


def enough(overlap: np.ndarray, na: np.ndarray, nb: np.ndarray, t: int) -> np.ndarray:
    """100 overlap >= t union, as overlap (100 + t) >= t (na + nb)."""
    return np.minimum(overlap, 1 << 50) * (100 + t) >= t * (na + nb)


class Points:
    """Sets of one group: ids, sizes, component labels, sides and count vectors at their own and at COARSE groups."""

    def __init__(self, sid: np.ndarray, n: np.ndarray, comp: np.ndarray, side: np.ndarray, vec: pa.Array):
        self.sid, self.n, self.comp, self.side = sid, n, comp, side
        data, offs = buffers(vec)
        self.wide = np.diff(offs)
        self.at = np.zeros(len(sid), np.int64)
        self.of: dict[int, np.ndarray] = {}
        self.coarse = np.zeros((len(sid), COARSE), np.uint16)
        self.full = np.zeros(len(sid), bool)
        for w in np.unique(self.wide).tolist():
            rows = np.flatnonzero(self.wide == w)
            self.at[rows] = np.arange(len(rows))
            self.of[w] = own = data[offs[rows][:, None] + np.arange(w)]
            self.full[rows] = (own == 255).any(axis=1)
            self.coarse[rows] = own.reshape(-1, w // COARSE, COARSE).sum(axis=1, dtype=np.uint16)
        self.coarse[self.full] = 65535

    def overlap(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the overlaps of the pairs (p, q), on as many groups as both have."""
        out = np.zeros(len(p), np.int64)
        kind = self.wide[p] * (2 * FINE) + self.wide[q]
        for k in np.unique(kind).tolist():
            wp, wq = k // (2 * FINE), k % (2 * FINE)
            g, own = min(wp, wq), np.flatnonzero(kind == k)
            step = max(16, (1 << 21) // max(wp, wq))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                x, y = self.of[wp][self.at[p[part]]], self.of[wq][self.at[q[part]]]
                x = x if wp == g else x.reshape(-1, wp // g, g).sum(axis=1, dtype=np.uint16)
                y = y if wq == g else y.reshape(-1, wq // g, g).sum(axis=1, dtype=np.uint16)
                out[part] = np.minimum(x, y).sum(axis=1, dtype=np.uint32)
        return np.where(self.full[p] | self.full[q], 1 << 50, out)

    def apart(self, p: np.ndarray, q: np.ndarray, t: int) -> np.ndarray:
        """Which pairs are of two components and sides (where there are two) and of sizes that allow the similarity."""
        n, crossed = self.n, self.side[p] != self.side[q] if self.side.any() and not self.side.all() else True
        return (self.comp[p] != self.comp[q]) & crossed & (100 * n[p] >= t * n[q]) & (100 * n[q] >= t * n[p])

    def slice(self, a: int, b: int) -> Points:
        out = object.__new__(Points)
        out.of = self.of
        for name in ("sid", "n", "comp", "side", "wide", "at", "coarse", "full"):
            setattr(out, name, getattr(self, name)[a:b])
        return out


class RTree:
    """A packed R-tree of count vectors: points sorted by size and then by their heaviest groups, leaves of LEAF points.

    A box keeps each coordinate's maximum, the range of sizes and the range of component labels below it.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray):
        order = np.lexsort((points.argmax(axis=1), sizes)) if len(points) else np.zeros(0, np.int64)
        self.order, self.points, self.sizes, self.labels = order, points[order], sizes[order], labels[order]
        self.levels = []
        high, small, large, low_label, high_label = self.points, self.sizes, self.sizes, self.labels, self.labels
        while len(high) > 1:
            cut = np.arange(0, len(high), LEAF)
            high, small, large = np.maximum.reduceat(high, cut), np.minimum.reduceat(small, cut), np.maximum.reduceat(large, cut)
            low_label, high_label = np.minimum.reduceat(low_label, cut), np.maximum.reduceat(high_label, cut)
            self.levels.append((high, small, large, low_label, high_label))

    def search(self, t: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs (i, j) of points of different labels whose bound meets the similarity t (percent); each pair once."""
        n = len(self.points)
        if n < 2:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q = np.repeat(np.arange(n), len(self.levels[-1][0]))
        node = np.tile(np.arange(len(self.levels[-1][0])), n)
        for depth in range(len(self.levels) - 1, -1, -1):
            high, small, large, low, up = self.levels[depth]
            ok = ~((low[node] == up[node]) & (low[node] == self.labels[q])) & (100 * large[node] >= t * self.sizes[q]) & (100 * self.sizes[q] >= t * small[node])
            q, node = q[ok], node[ok]
            q, node = self._bounded(q, node, high, small, t, step)
            below = n if depth == 0 else len(self.levels[depth - 1][0])
            child = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            q = np.repeat(q, LEAF)
            keep = child < below
            q, node = q[keep], child[keep]
        ok = (q < node) & (self.labels[q] != self.labels[node]) & (100 * self.sizes[node] >= t * self.sizes[q]) & (100 * self.sizes[q] >= t * self.sizes[node])
        q, node = self._bounded(q[ok], node[ok], self.points, self.sizes, t, step)
        return self.order[q], self.order[node]

    def _bounded(self, q, node, high, small, t, step):
        good = [np.zeros(0, bool)]
        for a in range(0, len(q), step):
            i, j = q[a : a + step], node[a : a + step]
            good.append(enough(overlap_bound(self.points[i], high[j]), self.sizes[i], small[j], t))
        ok = np.concatenate(good)
        return q[ok], node[ok]


def _rows(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def _packed(rows: np.ndarray, shard: np.ndarray, names: list[str], cols: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each run rows[i]:rows[i + 1] of the columns, which go as bytes."""
    packed = [pa.Array.from_buffers(pa.binary(), len(rows) - 1, [None, pa.py_buffer((rows * c.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(c))]) for c in cols]
    return _rows(["shard", *names], [shard.astype(np.int32), *packed])


def _by_shard(shard: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])


def _shards(batches, kinds: list):
    """(shard, columns) of packed rows sorted by shard, all rows of a shard together; negative shards row by row."""
    held, at = [], None
    for batch in batches:
        shard = batch.column(0).to_pylist()
        for i, k in enumerate(shard):
            row = [np.frombuffer(batch.column(c + 1)[i].as_buffer(), np.int64 if k < 0 and c == 0 else kind) for c, kind in enumerate(kinds)]
            if k < 0:
                yield k, row
                continue
            if k != at and held:
                yield at, [np.concatenate(x) for x in zip(*held, strict=True)]
                held = []
            at = k
            held.append(row)
    if held:
        yield at, [np.concatenate(x) for x in zip(*held, strict=True)]


def _often(batches):
    """Buckets (bucket, count) of COMMON postings or more, of packed rows (shard, keys, counts) sorted by shard."""
    for shard, (keys, counts) in _shards(batches, [np.uint32, np.uint32]):
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        total = np.add.reduceat(counts, first)
        many = total >= COMMON
        yield _rows(["bucket", "count"], [(shard << 32) + keys[first][many].astype(np.int64), total[many]])


def _shared(batches):
    """Postings (bucket, sid) of the buckets that several sets share, of packed rows (shard, keys, sids) sorted by shard.

    Rows of negative shards are of common shingles, which are shared, and pass as they are; so a bucket that holds many
    sets is never gathered.
    """
    for shard, (keys, sids) in _shards(batches, [np.uint32, np.int64]):
        if shard >= 0:
            order = np.lexsort((sids, keys))
            keys, sids = keys[order], sids[order]
            fresh = np.r_[True, (keys[1:] != keys[:-1]) | (sids[1:] != sids[:-1])]
            keys, sids = keys[fresh], sids[fresh]
            same = keys[1:] == keys[:-1]
            keep = np.r_[same, False] | np.r_[False, same]
            keys, sids = (shard << 32) + keys[keep].astype(np.int64), sids[keep]
        yield _rows(["bucket", "sid"], [keys, sids])


def shingle_set(text: str, width: int) -> set[tuple[bytes, ...]]:
    """The word shingles themselves."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII spaces
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def _verify(t: int, width: int):
    """Rows (a, b, text of a, text of b) sorted by a: the pairs whose sets have the similarity.

    Sets are compared by hashes once it is known that these stand for the same words in both texts; else as words.
    """

    def similar(a: np.ndarray, a_text: pa.Array, b_text: pa.Array) -> np.ndarray:
        new = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])  # sorted by a: its set is made once
        texts = pa.concat_arrays([a_text.take(pa.array(new)), b_text])
        s = Sets(*buffers(texts.fill_null("")), width)
        at = np.r_[np.repeat(np.arange(len(new)), np.diff(np.r_[new, len(a)])), len(new) + np.arange(len(a))]
        own = [s.value[s.first[i] : s.first[i + 1]] for i in range(len(texts))]
        size = s.size
        if not s.words.distinct(s.raw):
            own = [shingle_set(x or "", width) for x in texts.to_pylist()]
            size = np.array([len(x) for x in own], np.int64)
        both = np.zeros(len(a), np.int64)
        for i, (p, q) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True)):
            if isinstance(own[p], set):
                both[i] = len(own[p] & own[q])
            else:
                merged = np.concatenate([own[p], own[q]])
                merged.sort(kind="stable")  # two sorted runs merge in linear time
                both[i] = np.count_nonzero(merged[1:] == merged[:-1])
        return enough(both, size[at[: len(a)]], size[at[len(a) :]], t)

    def run(batches):
        for batch in batches:
            sizes = np.diff(buffers(batch.column(2).fill_null(""))[1]) + np.diff(buffers(batch.column(3).fill_null(""))[1])
            at = 0
            while at < batch.num_rows:
                n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 256]), VERIFIED, side="right")))
                part = batch.slice(at, n)
                a, b = part.column(0).to_numpy(), part.column(1).to_numpy()
                good = similar(a, part.column(2), part.column(3))
                yield _rows(["a", "b"], [a[good], b[good]])
                at += n

    return run


def _best(p: np.ndarray, q: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Which of the pairs (p, q) are the best of one of their sides."""
    keep = np.zeros(len(p), bool)
    for side in (p, q):
        order = np.lexsort((-score, side))
        if len(order):
            keep[order[np.r_[True, side[order][1:] != side[order][:-1]]]] = True
    return keep


def _search(t: int, best: bool):
    """Rows (route, i, j, side, sid, n, comp, vec) sorted by route, i, j: pairs of sets of each group that its search finds.

    With best only the pair with the highest bound for its sizes is kept for each set of a group.
    """

    def bounded(points: Points, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = points.overlap(p, q)
        good = enough(found, points.n[p], points.n[q], t)
        p, q, found = p[good], q[good], found[good]
        if best and len(p):
            keep = _best(p, q, np.minimum(found, 1 << 40) / (points.n[p] + points.n[q]))
            p, q = p[keep], q[keep]
        return p, q

    def leaves(first: np.ndarray, size: np.ndarray, points: Points) -> tuple[np.ndarray, np.ndarray]:
        """Groups of a leaf's size at most are single leaves: their points are compared together, a distance apart at a time."""
        left, right = [first[:0]], [first[:0]]
        for gap in range(1, LEAF):
            own = size > gap
            if not own.any():
                break
            count = size[own] - gap
            p = np.repeat(first[own] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
            ok = points.apart(p, p + gap, t)
            left.append(p[ok])
            right.append(p[ok] + gap)
        return bounded(points, np.concatenate(left), np.concatenate(right))

    def groups(table: pa.Table, edges: np.ndarray):
        side, sid, n, comp = (table[c].to_numpy() for c in ("side", "sid", "n", "comp"))
        points = Points(sid, n, comp, side, table["vec"].combine_chunks())
        first, size = edges[:-1], np.diff(edges)
        # a group of two sides is one of several of its route: the tree tells its pairs within a side from those across
        two = np.maximum.reduceat(side, first) != np.minimum.reduceat(side, first)
        small = (size <= LEAF) & ~two
        one = object.__new__(Points)
        one.__dict__ |= points.__dict__ | {"side": np.zeros(len(sid), np.int32)}
        found = [leaves(first[small], size[small], one)]
        for a, m in zip(first[~small].tolist(), size[~small].tolist(), strict=True):
            own = points.slice(a, a + m)
            p, q = RTree(own.coarse, own.n, own.comp).search(t)
            ok = own.apart(p, q, t)
            p, q = bounded(own, p[ok], q[ok])
            found.append((p + a, q + a))
        p, q = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        a, b = np.minimum(sid[p], sid[q]), np.maximum(sid[p], sid[q])
        once = np.unique(np.stack([a, b]), axis=1) if len(a) else np.stack([a, b])
        return _rows(["a", "b"], [np.ascontiguousarray(once[0]), np.ascontiguousarray(once[1])])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            table = pa.concat_tables(held).combine_chunks()
            keys = [table[c].to_numpy() for c in ("route", "i", "j")]
            if not len(keys[0]):
                continue
            cut = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
            edges = np.r_[0, cut]
            held = [table.slice(int(edges[-1]))]
            if len(cut):
                yield groups(table.slice(0, int(edges[-1])), edges)
        if held and held[0].num_rows:
            yield groups(pa.concat_tables(held), np.array([0, sum(x.num_rows for x in held)]))

    return run


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 80, width: int = 5) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z folded. Two documents are linked when 100 |A & B| >= t |A | B|;
    component_id is the smallest doc_id that links reach. Null texts and texts without words have an empty set, are
    linked with nothing and are their own component; fewer words than width are one shingle. Repeated rows keep their
    own result rows. Rows with a null id get their size and a null component and link nothing. The ids are bigint; other
    columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    work = Scratch(spark, "jaccard")
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    # an id may have several texts: id and hash of the text name a row's text
    hashed = slim.withColumn("h", F.xxhash64("text"))

    def describe(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch, "text"):
                s = Sets(data, offs, width)
                yield _rows(["doc_id", "h", "n", "sid", "chk"], [batch.column(0)[a:b], batch.column(2)[a:b], s.size, signed(s.sid), signed(s.check)])

    sets = work.table(hashed.mapInArrow(tidy(describe), "doc_id bigint, h bigint, n bigint, sid bigint, chk bigint"), "sets")
    real = sets.filter("n > 0 and doc_id is not null")
    # Half a digest names a set. Halves that two sets share (about 20 among 3 * 10**10 sets) are replaced by the other half.
    shared_ids = [r.sid for r in real.groupBy("sid").agg(F.min("chk").alias("x"), F.max("chk").alias("y")).filter("x != y").limit(MAX_CLASHES + 1).select("sid").collect()]
    if len(shared_ids) > MAX_CLASHES:
        raise ValueError("the digests of too many sets clash; change the seed of _SID")
    clashes = np.array(shared_ids, np.int64).view(np.uint64)
    if shared_ids:
        sets = sets.withColumn("sid", F.when(F.col("sid").isin(shared_ids), F.col("chk")).otherwise(F.col("sid")))
        real = sets.filter("n > 0 and doc_id is not null")
    reps = work.table(real.groupBy("sid").agg(F.min(F.struct("doc_id", "h")).alias("r"), F.max("n").alias("n")).select("sid", F.col("r.doc_id").alias("rep"), F.col("r.h").alias("h"), "n"), "reps")
    postings = real.agg(F.sum(F.expr(f"n - ceil(n * {t} / 100) + 1"))).first()[0] or 0
    shards = max(1, -(-int(postings) // SHARD))

    def sets_of(data: np.ndarray, offs: np.ndarray) -> Sets:
        return Sets(data, offs, width, clashes)

    def leading(batches):
        def flush():
            bucket, count = np.unique(np.concatenate(pending), return_counts=True)
            shard = bucket >> 32
            rows = _by_shard(shard)
            return _packed(rows, shard[rows[:-1]], ["keys", "counts"], [bucket.astype(np.uint32), count.astype(np.uint32)])

        pending, size = [], 0
        for batch in batches:
            for a, b, data, offs in blocks(batch, "text"):
                s = sets_of(data, offs)
                row, bucket = s.prefix(t, np.zeros(0, np.int64), shards)
                pending.append(bucket[s.once(batch.column(0)[a:b])[row]])
                size += len(pending[-1])
                if size >= FLUSH:
                    yield flush()
                    pending, size = [], 0
        if size:
            yield flush()

    counted = slim.mapInArrow(tidy(leading), "shard int, keys binary, counts binary").repartition("shard").sortWithinPartitions("shard")
    often = work.table(counted.mapInArrow(tidy(_often), "bucket bigint, count bigint"), "often")
    # the least count at which the common shingles are within their bound
    least, total = COMMON, 0
    for r in often.groupBy(F.least("count", F.lit(1 << 20)).alias("c")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("c")).collect():
        total += r.m
        if total > MAX_COMMON:
            least = r.c + 1
            break
    top = often.filter(F.col("count") >= least).select("bucket").toPandas()["bucket"].to_numpy()
    common = spark.sparkContext.broadcast(np.sort(top.astype(np.int64)))

    def post(batches):
        def flush():
            bucket, sid = (np.concatenate(x) for x in zip(*pending, strict=True))
            shard = bucket >> 32
            often_met = _among(bucket, common.value)
            order = np.lexsort((bucket, often_met))
            bucket, sid, shard, often_met = bucket[order], sid[order], shard[order], often_met[order]
            cut = int(np.searchsorted(often_met, True))
            if cut:
                rows = _by_shard(shard[:cut])
                yield _packed(rows, shard[rows[:-1]], ["keys", "sids"], [bucket[:cut].astype(np.uint32), sid[:cut]])
            if cut < len(bucket):
                rows = np.unique(np.r_[np.arange(0, len(bucket) - cut, 4096), len(bucket) - cut])
                yield _packed(rows, -1 - np.abs(sid[cut + rows[:-1]] % shards), ["keys", "sids"], [bucket[cut:], sid[cut:]])

        pending, size = [], 0
        for batch in batches:
            for a, b, data, offs in blocks(batch, "text"):
                s = sets_of(data, offs)
                row, bucket = s.prefix(t, common.value, shards)
                keep = s.once(batch.column(0)[a:b])[row]
                pending.append((bucket[keep], signed(s.sid)[row[keep]]))
                size += int(keep.sum())
                if size >= FLUSH:
                    yield from flush()
                    pending, size = [], 0
        if size:
            yield from flush()

    posted = slim.mapInArrow(tidy(post), "shard int, keys binary, sids binary").repartition("shard").sortWithinPartitions("shard")
    shared = work.table(posted.mapInArrow(tidy(_shared), "bucket bigint, sid bigint"), "shared")
    work.drop("often")

    def chosen(wanted: DataFrame):
        """A function that keeps the rows of a batch whose ids are among those wanted, and some more."""
        near = spark.sparkContext.broadcast(bloom(wanted, "rep", wanted.count()))

        def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = batch.column(0)
            return batch.filter(pa.array(near.value.has(ids.fill_null(0).to_numpy()) & np.asarray(ids.is_valid())))

        return keep

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs (a, b) of ids whose sets are similar. Texts are moved, which are smaller than their sets."""
        side = {c: reps.select(F.col("sid").alias(c), F.col("rep").alias(f"{c}_rep"), F.col("h").alias(f"{c}_h")) for c in "ab"}
        named = work.table(pairs.join(side["a"], "a").join(side["b"], "b"), f"{name}_pairs")
        wanted = work.table(named.select(F.explode(F.array(F.struct(F.col("a_rep").alias("rep"), F.col("a_h").alias("h")), F.struct(F.col("b_rep").alias("rep"), F.col("b_h").alias("h")))).alias("w")).select("w.rep", "w.h").distinct(), f"{name}_wanted")
        keep = chosen(wanted)

        def likely(batches):
            for batch in batches:
                yield keep(batch)

        texts = hashed.mapInArrow(tidy(likely), "doc_id bigint, text string, h bigint").join(wanted.withColumnRenamed("rep", "doc_id"), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
        own = {c: texts.select(F.col("doc_id").alias(f"{c}_rep"), F.col("h").alias(f"{c}_h"), F.col("text").alias(f"{c}_text")) for c in "ab"}
        both = named.join(own["b"], ["b_rep", "b_h"]).join(own["a"], ["a_rep", "a_h"])
        found = work.table(both.select("a", "b", "a_text", "b_text").mapInArrow(tidy(_verify(t, width)), "a bigint, b bigint"), name)
        work.drop(f"{name}_pairs", f"{name}_wanted")
        return found

    def described(cells: DataFrame) -> DataFrame:
        """The count vector (sid, vec) of each set in the cells."""
        wanted = work.table(cells.select("sid").distinct().join(reps, "sid").select("sid", "rep", "h"), "points_of")

        keep = chosen(wanted)

        def count(batches):
            for whole_batch in batches:
                batch = keep(whole_batch)
                for a, b, data, offs in blocks(batch, "text"):
                    yield _rows(["rep", "h", "vec"], [batch.column(0)[a:b], batch.column(2)[a:b], Sets(data, offs, width).counts()])

        made = hashed.mapInArrow(tidy(count), "rep bigint, h bigint, vec binary")
        return work.table(made.join(wanted, ["rep", "h"]).select("sid", "vec").dropDuplicates(["sid"]), "points")

    # A set's share of prefix shingles that other sets have too: highest for the original of a family of edited copies.
    # Of the hubs of its buckets each set takes the one it shares most buckets with, and only a likely one is verified.
    sizes = reps.select("sid", "n")
    central = shared.groupBy("sid").count().join(sizes, "sid").select("sid", "n", (F.col("count") / F.col("n")).alias("central"))
    ranked = work.table(shared.join(central, "sid"), "ranked")
    hubs = ranked.groupBy("bucket").agg(F.max(F.struct("central", "sid", "n")).alias("h")).select("bucket", F.col("h.sid").alias("hub"), F.col("h.n").alias("hub_n"))
    near = ranked.join(hubs, "bucket").filter((F.col("sid") != F.col("hub")) & (100 * F.col("n") >= t * F.col("hub_n")) & (100 * F.col("hub_n") >= t * F.col("n")))
    votes = near.groupBy("sid", "n", "hub", "hub_n").count()
    prefix = F.least("n", "hub_n") * (100 - t) / 100
    votes = votes.filter(100 * F.col("count") >= LIKELY * F.floor(prefix)).groupBy("sid").agg(F.max_by("hub", F.struct("count", "hub")).alias("hub"))
    links = verified(votes.select(F.col("hub").alias("a"), F.col("sid").alias("b")), "linked")
    work.drop("ranked")
    whole, vectors = work.table(connected_components(links), "part"), None
    for name, best in (("best", True), ("rest", False)):
        labelled = shared.join(whole.withColumnRenamed("node", "sid"), "sid", "left").select("bucket", "sid", F.coalesce("component", "sid").alias("comp"))
        # buckets that still hold several components; those of one family mostly have one smallest member
        open_ = labelled.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.min("sid").alias("route")).filter("x != y").select("bucket", "route")
        cells = work.table(labelled.join(open_, "bucket").select("route", "sid", "comp").distinct().join(sizes, "sid"), f"{name}_cells")
        vectors = vectors or described(cells)  # later cells are of sets that these have too
        parts = cells.groupBy("route").agg(F.ceil(F.sum(F.when(F.col("n") > FINE // 2, 2).otherwise(1)) / TREE_POINTS).cast("int").alias("parts"))
        apart = cells.join(parts, "route").join(vectors, "sid")
        own = F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")
        dealt = apart.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = dealt.select("route", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"), "sid", "n", "comp", "vec")
        pairs = dealt.repartition("route", "i", "j").sortWithinPartitions("route", "i", "j").mapInArrow(tidy(_search(t, best)), "a bigint, b bigint")
        more = verified(pairs.distinct(), name)
        whole = work.table(connected_components(whole.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), f"{name}_part")
        work.drop(f"{name}_cells")
    work.drop("shared", "points", "points_of")
    roots = reps.join(whole.withColumnRenamed("node", "sid"), "sid", "left").select("sid", "rep", F.coalesce("component", "sid").alias("root"))
    least_id = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    class_of = roots.join(least_id, "root").select("sid", "component_id")
    out = sets.select("doc_id", "n", "sid").join(class_of, "sid", "left")
    alone = F.col("doc_id").isNull() | (F.col("n") == 0)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", t: int = 80) -> DataFrame:
    """The rows of docs, all columns, whose id is the smallest of its component; rows with a null id stay."""
    key = free_name(docs, "gone")
    gone = similar_sets(docs, id_col, text_col, t).filter("component_id != doc_id").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, docs[id_col] == gone[key], "left_anti")
