"""Near-duplicate passages by compact windows.

A passage is a stretch of at least min_words words. Under one hash of the word shingles, all stretches of that length or
more that share a minimum form compact windows (left, centre, right): the Cartesian tree over the hashes has one node for
each. Only about two in min_words positions are minima of such a stretch; they are found by sliding minima, and the tree
is built over them alone.

Windows of two texts whose centres have one shingle, and whose context on one side has one minimum too, point at a
passage that both may hold. A repeated passage is found by each of the hashes: its minimum is the same in both texts, and
the longer side of the minimum lies within the passage. Windows of one key are linked with the first of them, first within
what a task gathers and then across tasks, so a passage of any number of documents costs a link for each. Windows whose
intervals overlap by a passage's length at least are compared: links of one pair of texts name the diagonals on which runs
of equal shingles are looked for; runs are chained across diagonals, so that inserted and deleted words don't end a
passage, and the chains are verified by their similarity.

Where the first window of a key holds only a common stretch that is shorter than a passage, the windows about that
stretch are split by the words that follow it on either side, and each part is linked with its own first window, until
every part is settled: two texts that share a passage about the stretch agree beyond it on one side at least.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import Words, blocks, column, mix, signed, stream, tidy
from curata.llm.scratch import Scratch, bloom, free_name

HASHES, WIDTH = 2, 5
_SEED = stream(71, 16)
_LOW = np.uint64((1 << 24) - 1)
#: Bits of a window's reach on each side of its centre, and so the longest passage that can be asked for.
REACH_BITS = 16
REACH = (1 << REACH_BITS) - 1
#: Windows that a task gathers before it looks for those that share a key.
FLUSH = 1 << 20


def sliding_minima(x: np.ndarray, width: int) -> np.ndarray:
    """min(x[i:i+width]) for each i at which that many values follow; linear time, by minima within tiles."""
    n = len(x)
    if n < width:
        return x[:0]
    tiles = -(-n // width)
    padded = np.full(tiles * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(tiles, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def cartesian_windows(values: list[int]) -> tuple[list[int], list[int]]:
    """For each value the indices of the nearest smaller ones before and after (-1, len): its subtree in the tree."""
    n = len(values)
    left, right, stack = [-1] * n, [n] * n, []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    return left, right


def _steady(x: np.ndarray, picked: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The distinct minima of stretches that begin at begin; a minimum stands while it lies in the stretch and none is lower.

    In a text that repeats itself equal minima follow at each period; this takes one in a stretch's length of them.
    """
    if not len(picked):
        return picked
    last = np.flatnonzero(np.r_[picked[1:] != picked[:-1], True])
    candidates, until = picked[last].tolist(), begin[last].tolist()
    values = (x[picked[last]] & ~_LOW).tolist()
    out, at, value = [], -1, -1
    for c, end, v in zip(candidates, until, values, strict=True):
        if v != value or at < end:
            out.append(c)
            at, value = c, v
    return np.array(out, np.int64)


def compact_windows(shingles: np.ndarray, first: np.ndarray, length: int, seed: np.uint64) -> tuple[np.ndarray, ...]:
    """(row, centre, left, right, key of the left context, key of the right context) of all windows of length or more.

    Positions count a row's shingles from 0; a key of 0 says that the row ends within the context.
    """
    rows = len(first) - 1
    row = np.repeat(np.arange(rows), np.diff(first))
    hashed = mix(shingles ^ seed)
    x = np.zeros(len(shingles) + rows + 1, np.uint64)  # a zero before each row and at the end stops every window
    at = np.arange(len(shingles)) + row + 1
    x[at] = np.maximum(hashed & ~_LOW, ~_LOW & (_LOW + np.uint64(1)))
    place = np.arange(len(x), dtype=np.uint64)
    x |= _LOW - (place & _LOW)  # of equal hashes the last is the smallest
    low = sliding_minima(x, length)
    begin = np.flatnonzero(low > _LOW).astype(np.uint64)
    picked = (begin + ((_LOW - (low[begin.astype(np.int64)] & _LOW) - begin) & _LOW)).astype(np.int64)
    centre = _steady(x, picked, begin.astype(np.int64))
    stops = np.flatnonzero(x <= _LOW)
    nodes = np.union1d(centre, stops)
    left, right = cartesian_windows(x[nodes].tolist())
    mine = np.flatnonzero(x[nodes] > _LOW)
    l = nodes[np.array(left, np.int64)[mine]] + 1
    r = nodes[np.array(right, np.int64)[mine]] - 1
    c = nodes[mine]
    side = length // 2 - 1
    context = sliding_minima(x, side)
    own = mix(x[c] & ~_LOW)
    before = np.where(c - side >= 0, context[np.maximum(c - side, 0)], 0) if len(context) else np.zeros(len(c), np.uint64)
    after = np.where(c + 1 < len(context), context[np.minimum(c + 1, len(context) - 1)], 0) if len(context) else np.zeros(len(c), np.uint64)
    keys = [np.where(v > _LOW, mix(own + (v & ~_LOW) + np.uint64(k)), np.uint64(0)) for k, v in enumerate((before, after), 1)]
    i = np.searchsorted(stops, c) - 1
    base = stops[i] + 1
    # every stretch of this length lies about its minimum, also where equal hashes cut the tree's windows short
    l = np.maximum(base, np.minimum(l, c - length + 1))
    r = np.minimum(stops[i + 1] - 1, np.maximum(r, c + length - 1))
    return i, c - base, l - base, r - base, keys[0], keys[1]


def _rows(names: list[str], cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)


def _windows(length: int):
    """Rows (key, doc, ver, window) of documents.

    Windows of a key among those that a task gathers are keyed anew by these, but the first: a key of very many documents
    has a row for each FLUSH windows of a task.
    """

    def starred(pending: list) -> pa.RecordBatch:
        key, own, ver, packed = (np.concatenate(x) for x in zip(*pending, strict=True))
        order = np.lexsort((packed, ver, own, key))
        key, own, ver, packed = key[order], own[order], ver[order], packed[order]
        new = np.r_[True, key[1:] != key[:-1]]
        many = ~new | np.r_[~new[1:], False]
        salt = mix(np.array([own[0], own[-1], packed[0], len(own)]).astype(np.uint64)).sum(dtype=np.uint64)
        return _rows(["key", "doc", "ver", "window"], [signed(np.r_[key[new], mix(key[many] + salt)]), *[np.r_[x[new], x[many]] for x in (own, ver, packed)]])

    def run(batches):
        pending, size = [], 0
        for batch in batches:
            ids = batch.column(0)
            batch = batch.filter(ids.is_valid())
            for a, b, data, offs in blocks(batch, "text"):
                doc, ver = (batch.column(k)[a:b].to_numpy() for k in (0, 2))
                shingles, first = Words(data, offs).shingles(WIDTH)
                for k in range(HASHES):
                    i, c, l, r, before, after = compact_windows(shingles, first, length, _SEED[k])
                    packed = (c << 2 * REACH_BITS) | (np.minimum(c - l, REACH) << REACH_BITS) | np.minimum(r - c, REACH)
                    for key in (before, after):
                        has = key != 0
                        pending.append((key[has] + np.uint64(k), doc[i[has]], ver[i[has]], packed[has]))
                        size += len(pending[-1][0])
                if size >= FLUSH:
                    yield starred(pending)
                    pending, size = [], 0
        if size:
            yield starred(pending)

    return run


def _stars(length: int):
    """Rows (key, doc, ver, window) sorted in this order: links of the centres of each with those of the key's first row.

    Two windows are linked where their intervals about the centres overlap by the length at least.
    """

    def run(batches):
        held = None
        for batch in batches:
            k, d, v, w = (batch.column(i).to_numpy() for i in range(4))
            if not len(k):
                continue
            new = np.r_[held is None or k[0] != held[0], k[1:] != k[:-1]]
            at = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            hub, hub_v, hub_w = (np.where(at < 0, held[n] if held else 0, x[at]) for n, x in enumerate((d, v, w), 1))
            held = (k[-1], hub[-1], hub_v[-1], hub_w[-1])
            left, right = (np.minimum(w >> by & REACH, hub_w >> by & REACH) for by in (REACH_BITS, 0))
            far = ((d != hub) | (v != hub_v)) & (left + right + 1 >= length)
            yield _rows(["doc", "ver", "c", "hub", "hub_ver", "hub_c"], [d[far], v[far], w[far] >> 2 * REACH_BITS, hub[far], hub_v[far], hub_w[far] >> 2 * REACH_BITS])

    return run


def _runs(x: np.ndarray, y: np.ndarray, diags: list[int]) -> list[tuple[int, int, int]]:
    """Stretches (start, end, diagonal) in which x[i] == y[i - diagonal], as long as they are, by start."""
    out = []
    for d in diags:
        a, b = max(0, d), min(len(x), len(y) + d)
        if a < b:
            edge = np.flatnonzero(np.diff(np.r_[False, x[a:b] == y[a - d : b - d], False]))
            out += [(a + s, a + e, d) for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
    return sorted(out)


def aligned_passages(x: np.ndarray, y: np.ndarray, diags: list[int], length: int, t: int) -> list[tuple[int, int, int, float]]:
    """Stretches (start, end, start in y, similarity) of x, of length or more, that y holds to a Jaccard similarity of t percent.

    Runs of equal shingles on the given diagonals, and on those of shingles that both hold once, are chained in the order
    of both texts, so that words may be replaced, inserted and deleted: m shingles in common and u places left out on
    either side are m of m + u. A run joins the chain that keeps most of (100 - t) m - t u, which must not get below 0.
    A stretch is no longer than m + u, so texts with less than t percent of length in common hold none, and no run is looked for.
    """
    (vx, ix, nx), (vy, iy, ny) = (np.unique(v, return_index=True, return_counts=True) for v in (x, y))
    _, p, q = np.intersect1d(vx, vy, assume_unique=True, return_indices=True)
    if 100 * int(nx[p].sum()) < t * length:
        return []
    single = (nx[p] == 1) & (ny[q] == 1)
    p, q = p[single], q[single]
    slack = len(x) * (100 - t) // t
    others = ix[p] - iy[q]
    others = others[(others >= min(diags) - slack) & (others <= max(diags) + slack)]
    runs = _runs(x, y, sorted({*diags, *others.tolist()}))
    start, end, diag = (np.array(c, np.int64) for c in zip(*runs, strict=True)) if runs else (np.zeros(0, np.int64),) * 3
    score, common, prev = (100 - t) * (end - start), end - start, np.full(len(runs), -1)
    for i in range(1, len(runs)):
        # in both texts what overlaps the run before is cut from the front
        ahead, behind = end[:i] - start[i], end[:i] - diag[:i] - start[i] + diag[i]
        cut = np.maximum(0, np.maximum(ahead, behind))
        joined = np.where(end[i] - start[i] > cut, score[:i] - t * (2 * cut - ahead - behind) + (100 - t) * (end[i] - start[i] - cut), -1)
        k = int(joined.argmax())
        if joined[k] >= 0:
            score[i], common[i], prev[i] = joined[k], common[k] + end[i] - start[i] - cut[k], k
    out, used = [], set()
    for i in np.argsort(-common, kind="stable").tolist():  # the longest chains take their runs first
        chain, m, u = [], 0, 0
        while i >= 0 and i not in used:
            used.add(i)
            chain.append(i)
            i = int(prev[i])
        for k, i in enumerate(reversed(chain)):
            s, e, d = runs[i]
            if k:
                cut = max(0, ex - s, ey - s + d)
                u += 2 * (s + cut) - d - ex - ey
                m += e - s - cut
            else:
                first, m = (s, s - d), e - s
            ex, ey = e, e - d
        if chain and ex - first[0] >= length and t * (m + u) <= 100 * m:
            out.append((first[0], ex, first[1], m / (m + u)))
    return sorted(out)


_FOUND = "doc_id bigint, version bigint, start_word bigint, end_word bigint, source_id bigint, source_start bigint, similarity double"
_MEMBER = "c bigint, part bigint, open boolean, before bigint, after bigint"
_MEMBER_KINDS = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
_NAMES = [f.split()[0] for f in f"{_FOUND}, {_MEMBER}".split(", ")]


def _equal(x: np.ndarray, y: np.ndarray) -> int:
    """How many values x and y begin with in common."""
    n = min(len(x), len(y))
    odd = np.flatnonzero(x[:n] != y[:n])
    return int(odd[0]) if len(odd) else n


def _part(*values: int) -> int:
    out = np.zeros(1, np.uint64)
    for v in values:
        out = mix(out ^ np.array([v & (1 << 64) - 1], np.uint64))
    return int(out.view(np.int64)[0])


def _verify(length: int, t: int):
    """Rows of document pairs with the linked centres: their passages (c is null), and the centres for the next round.

    A centre has its part (in the first round its shingle) and whether no passage of the pair covers it. After the first
    round a centre about which a stretch agrees that is shorter than a passage also has the parts that the shingles before
    and after the stretch lead to; in the first round the hub's centres are given too, as covered.
    """

    def grown(x: np.ndarray, y: np.ndarray, c: int, h: int, part: int) -> tuple[int | None, int | None]:
        ahead, behind = _equal(x[c : c + length], y[h : h + length]), _equal(x[max(0, c - length) : c][::-1], y[max(0, h - length) : h][::-1])
        if ahead + behind >= length or not ahead:
            return None, None
        return _part(part, 1, behind, int(x[c - behind - 1])) if c > behind else None, _part(part, 2, ahead, int(x[c + ahead])) if c + ahead < len(x) else None

    def run(batches):
        for batch in batches:
            doc, ver, hub, hub_ver, hub_lo = (batch.column(i).to_numpy() for i in range(5))
            mine, theirs = batch.column(6), batch.column(7)
            lists = batch.column(5)
            cuts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy())].astype(np.int64)
            flat = lists.flatten()
            all_c, all_h = (flat.field(k).to_numpy() for k in (0, 1))
            parts = flat.field(2).to_pylist() if flat.field(2).null_count < len(flat) else None
            found_rows, member, side = [], [], []
            for i in range(len(doc)):
                x, y = np.frombuffer(mine[i].as_buffer(), np.uint32), np.frombuffer(theirs[i].as_buffer(), np.uint32)
                own = slice(int(cuts[i]), int(cuts[i + 1]))
                base, c = int(hub_lo[i]), all_c[own]
                h = all_h[own] - base
                found = aligned_passages(x, y, np.unique(c - h).tolist(), length, t) if (doc[i], ver[i]) != (hub[i], hub_ver[i]) else []
                covered = np.zeros(len(c), bool)
                for s, e, at, sim in found:
                    covered |= (s <= c) & (c < e)
                    found_rows.append((doc[i], ver[i], s, e + WIDTH - 1, hub[i], base + at, sim))
                if parts is None:
                    member.append((np.full(len(c), doc[i]), np.full(len(c), ver[i]), c, x[c].astype(np.int64), ~covered))
                    member.append((np.full(len(c), hub[i]), np.full(len(c), hub_ver[i]), base + h, y[h].astype(np.int64), np.zeros(len(c), bool)))
                else:
                    mine_parts = np.array(parts[own], np.int64)
                    member.append((np.full(len(c), doc[i]), np.full(len(c), ver[i]), c, mine_parts, ~covered))
                    side += [grown(x, y, cc, hh, pp) for cc, hh, pp in zip(c.tolist(), h.tolist(), mine_parts.tolist(), strict=True)]
            cols = list(zip(*found_rows, strict=True)) if found_rows else [()] * 7
            n = len(found_rows)
            if n:
                values = [pa.array(v, k) for v, k in zip(cols, [*[pa.int64()] * 6, pa.float64()], strict=True)]
                yield _rows(_NAMES, [*values, *[pa.nulls(n, k) for k in _MEMBER_KINDS]])
            if member:
                ids, vers, c, part, open_ = (np.concatenate(v) for v in zip(*member, strict=True))
                m = len(ids)
                before, after = (pa.array([v[k] for v in side], pa.int64()) if parts is not None else pa.nulls(m, pa.int64()) for k in (0, 1))
                yield _rows(_NAMES, [pa.array(ids, pa.int64()), pa.array(vers, pa.int64()), *[pa.nulls(m, pa.int64())] * 4, pa.nulls(m, pa.float64()), pa.array(c.astype(np.int64)), pa.array(part), pa.array(open_), before, after])

    return run


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, t: int = 80) -> DataFrame:
    """One row per passage that an earlier document holds too: doc_id, version, start_word, end_word, source_id, source_start, similarity.

    Words are counted from 0, end_word is exclusive; the source is a document of smaller id, of several one. Passages have
    min_words words or more, in common with the source up to a similarity of t percent of the word shingles of the two
    aligned passages, with words replaced, inserted or deleted. No passage that repeats word for word is missed as a whole;
    edited ones are found by the windows that the edits leave. The first document that holds a passage has no row for it.
    Repetition within a document is none of this operator's business. Null and short texts have no passage; rows with a
    null id are skipped; repeated rows of one id and text are one document. The texts of an id that has several are
    documents of their own, in the order of their hashes: version tells them apart (version_of), and the source of one may
    be another. The ids are bigint; other columns are ignored.
    """
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return _passages(slim.withColumn("version", version_of(slim)), min_words, t)


def version_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Column:
    """A column of docs that tells the texts of one id apart: 0 for ids with one text (nearly all of them), else the text's hash."""
    spark = docs.sparkSession
    work = Scratch(spark, "versions")
    own, h = F.col(id_col).cast("bigint"), F.xxhash64(F.col(text_col))
    hashed = docs.select(own.alias("doc_id"), h.alias("h")).filter("doc_id is not null")
    several = work.table(hashed.groupBy("doc_id").agg(F.min("h").alias("x"), F.max("h").alias("y")).filter("x != y").select("doc_id"), "several")
    odd = spark.sparkContext.broadcast(bloom(several, "doc_id", several.count()))
    work.drop("several")

    @F.pandas_udf("bigint")
    def version(doc: pd.Series, h: pd.Series) -> pd.Series:
        ids = doc.fillna(0).to_numpy().astype(np.int64)
        return pd.Series(np.where(doc.notna().to_numpy() & odd.value.has(ids), h.to_numpy(), 0))

    return version(own, h)


def _passages(slim: DataFrame, min_words: int, t: int) -> DataFrame:
    spark = slim.sparkSession
    work = Scratch(spark, "passages")
    length = min_words - WIDTH + 1
    if not 4 <= length <= REACH:
        raise ValueError(f"min_words is from {WIDTH + 3} to {REACH + WIDTH - 1}")
    keyed = slim.mapInArrow(tidy(_windows(length)), "key bigint, doc bigint, ver bigint, window bigint").repartition("key").sortWithinPartitions("key", "doc", "ver", "window")
    links = work.table(keyed.mapInArrow(tidy(_stars(length)), "doc bigint, ver bigint, c bigint, hub bigint, hub_ver bigint, hub_c bigint"), "links")
    involved = links.select(F.explode(F.array("doc", "hub")).alias("doc_id")).distinct()
    near = spark.sparkContext.broadcast(bloom(involved, "doc_id", involved.count()))

    def texts(batches):
        for batch in batches:
            ids = batch.column(0)
            own = batch.filter(pa.array(near.value.has(ids.fill_null(0).to_numpy()) & np.asarray(ids.is_valid())))
            for a, b, data, offs in blocks(own, "text"):
                shingles, first = Words(data, offs).shingles(WIDTH)
                packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((first * 4).astype(np.int32).tobytes()), pa.py_buffer((shingles >> np.uint64(32)).astype(np.uint32).tobytes())])
                yield _rows(["doc_id", "version", "shingles"], [own.column(0)[a:b], own.column(2)[a:b], packed])

    kept = work.table(slim.mapInArrow(tidy(texts), "doc_id bigint, version bigint, shingles binary").dropDuplicates(["doc_id", "version"]), "texts")

    def texts_of(rows: DataFrame) -> DataFrame:
        """The texts of a round's documents, and some more: what isn't looked at isn't moved."""
        ids = rows.select(F.explode(F.array("doc", "hub")).alias("doc_id")).distinct()
        some = spark.sparkContext.broadcast(bloom(ids, "doc_id", ids.count()))

        def run(batches):
            for batch in batches:
                yield batch.filter(pa.array(some.value.has(batch.column(0).to_numpy())))

        return kept.mapInArrow(tidy(run), "doc_id bigint, version bigint, shingles binary")

    def verified(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Passages and centres of links (doc, ver, c, hub, hub_ver, hub_c, part)."""
        held = kept if name == "round0" else texts_of(rows)
        pair = ["doc", "ver", "hub", "hub_ver"]
        pairs = rows.groupBy(*pair).agg(F.collect_set(F.struct("c", "hub_c", "part")).alias("centres"))
        diags = F.transform("centres", lambda x: x["c"] - x["hub_c"])
        pairs = pairs.withColumn("most", F.array_max(diags)).withColumn("least", F.array_min(diags))
        mine = pairs.join(held, (F.col("doc") == F.col("doc_id")) & (F.col("ver") == F.col("version"))).select(*pair, "centres", "most", "least", F.col("shingles").alias("mine"))
        # a passage of n shingles has at most n (100 - t) / t places of the source left out, so the source ends there
        slack = F.expr(f"length(mine) div 4 * {100 - t} div {t} + {length}")
        mine = mine.withColumn("hub_lo", F.greatest(F.lit(0), -F.col("most") - slack)).withColumn("hub_hi", F.expr("length(mine) div 4") - F.col("least") + slack)
        theirs = F.expr("substring(shingles, cast(4 * hub_lo + 1 as int), cast(least(4 * (hub_hi - hub_lo), length(shingles)) as int))")
        both = mine.join(held, (F.col("hub") == F.col("doc_id")) & (F.col("hub_ver") == F.col("version"))).select(*pair, "hub_lo", "centres", "mine", theirs.alias("theirs"))
        out = work.table(both.mapInArrow(tidy(_verify(length, t)), f"{_FOUND}, {_MEMBER}"), name)
        return out.filter("c is null").select(*[f.split()[0] for f in _FOUND.split(", ")]), out.filter("c is not null")

    found, members = verified(links.withColumn("part", F.lit(None).cast("bigint")), "round0")
    own = [F.col("doc_id").alias("doc"), F.col("version").alias("ver"), "c"]
    parts = members.groupBy("part", *own).agg(F.min("open").alias("open"))
    for k in range(1, length + 2):
        # parts with a centre that no passage covers, and another document: each is linked with its first centre
        text = F.struct("doc", "ver")
        hubs = parts.groupBy("part").agg(F.min(F.struct("doc", "ver", "c")).alias("h"), F.max("open").alias("some"), F.max(text).alias("last")).filter(F.col("some") & (F.col("last") != F.struct("h.doc", "h.ver")))
        named = hubs.select("part", F.col("h.doc").alias("hub"), F.col("h.ver").alias("hub_ver"), F.col("h.c").alias("hub_c"))
        split = parts.join(named, "part").filter((F.col("doc") != F.col("hub")) | (F.col("ver") != F.col("hub_ver")) | (F.col("c") != F.col("hub_c")))
        split = work.table(split, f"links{k}")
        if split.isEmpty():
            break
        more, members = verified(split, f"round{k}")
        work.drop(f"links{k - 1}" if k > 1 else "links")
        found = found.unionByName(more)
        # a centre stays open where it was and still is
        was = split.select("part", F.col("doc").alias("doc_id"), F.col("ver").alias("version"), "c", F.col("open").alias("was"))
        grown = members.join(was, ["part", "doc_id", "version", "c"]).select("doc_id", "version", "c", (F.col("open") & F.col("was")).alias("open"), F.explode(F.array("before", "after")).alias("next")).filter("next is not null")
        parts = grown.groupBy(F.col("next").alias("part"), *own).agg(F.min("open").alias("open"))
    else:
        raise RuntimeError("parts of a common stretch didn't settle")
    out = work.table(found.distinct(), "found")
    work.drop("texts", *[f"{name}{j}" for name in ("links", "round") for j in range(k + 1)])
    return out


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, t: int = 80) -> DataFrame:
    """The rows of docs, all columns, without the passages that earlier documents hold; n_chars, if there, is counted anew.

    The words of a passage go with the white space before each but the first. A text left without words goes as a row.
    """
    if docs.schema[text_col].dataType.simpleString() != "string":
        raise TypeError(f"{text_col} is a string column")
    work = Scratch(docs.sparkSession, "cuts")
    key, same, own, ver = (free_name(docs, c) for c in ("cut_id", "cut_text", "cut_spans", "cut_version"))
    versioned = docs.withColumn(ver, version_of(docs, id_col, text_col))
    slim = versioned.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"), F.col(ver).alias("version"))
    # spans of several sources overlap: those that are told apart only by their sources count once
    found = work.table(_passages(slim, min_words, t).select("doc_id", "version", "start_word", "end_word").distinct(), "cuts")
    spans = found.groupBy(F.col("doc_id").alias(key), F.col("version").alias(same)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(own))
    names = docs.columns

    def run(batches):
        for batch in batches:
            spans_of = batch.column(len(names))
            keep, texts = [], []
            for i, cuts in enumerate(spans_of.to_pylist()):
                text = batch.column(names.index(text_col))[i].as_py()
                if cuts and text:
                    data = text.encode()
                    w = Words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
                    gone = np.zeros(len(w.start) + 1, np.int64)
                    for s in cuts:
                        gone[min(s["start_word"], len(w.start))] += 1
                        gone[min(s["end_word"], len(w.start))] -= 1
                    left = np.cumsum(gone)[:-1] == 0
                    parts, last = [], 0
                    edge = np.flatnonzero(np.diff(np.r_[True, left, True].astype(np.int8)))
                    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        parts.append(data[last : w.start[s]])
                        last = int(w.end[e - 1])
                    parts.append(data[last:])
                    text = b"".join(parts).decode()
                    keep.append(bool(left.any()))
                else:
                    keep.append(True)
                texts.append(text)
            cols = {n: batch.column(k) for k, n in enumerate(names)}
            cols[text_col] = pa.array(texts, cols[text_col].type)
            if "n_chars" in cols and pa.types.is_integer(cols["n_chars"].type):
                cols["n_chars"] = pa.array([c if not s or t is None else len(t) for c, s, t in zip(cols["n_chars"].to_pylist(), spans_of.to_pylist(), texts, strict=True)], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays([cols[n] for n in names], names).filter(pa.array(keep, pa.bool_()))

    joined = versioned.join(spans, (versioned[id_col].cast("bigint") == spans[key]) & (versioned[ver] == spans[same]), "left")
    return joined.select(*(versioned[n] for n in names), own).mapInArrow(tidy(run), docs.schema)
