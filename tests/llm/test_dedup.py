"""Exact dedup, the Jaccard join and substring dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import exact_dedup, jaccard_join, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def exact_brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    groups = defaultdict(list)
    for (i, *_), t in zip(rows, norm, strict=True):
        groups[t].append(i)
    out = []
    for (i, *_), t in zip(rows, norm, strict=True):
        ids = [x for x in groups[t] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[t]), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_exact_groups(spark, docs_of, odd_rows):
    got = [tuple(r) for r in exact_dedup.exact_groups(docs_of(odd_rows)).collect()]
    assert sorted(got, key=repr) == exact_brute(odd_rows)
    assert exact_dedup.exact_groups(docs_of([])).count() == 0
    kept = exact_dedup.drop_copies(docs_of(odd_rows))
    assert kept.columns == docs_of(odd_rows).columns
    assert sorted(r.doc_id for r in kept.filter("doc_id < 10").collect()) == [0, 2, 3, 5, 6, 7, 8, 9]


def test_copies_with_null_ids_are_dropped(spark, docs_of, odd_rows):
    want = sorted((i for i, _, _, kept, _ in exact_brute(odd_rows) if kept), key=repr)
    assert None not in want
    assert sorted((r.doc_id for r in exact_dedup.drop_copies(docs_of(odd_rows)).collect()), key=repr) == want
    alone = exact_dedup.drop_copies(docs_of([(None, "x y", None), (None, "x  y", None), (1, "z", None)]))
    assert sorted((r.doc_id for r in alone.collect()), key=repr) == [1, None, None]


@pytest.mark.parametrize("bits", [12, 24, 40, 63])
def test_quotient_filters_merge_without_loss(bits):
    from collections import Counter

    rng, f = np.random.default_rng(0), exact_dedup.QuotientFilter
    spread = rng.integers(0, 1 << min(bits, 62), 300).astype(np.uint64)
    crowded = rng.integers(0, 40, 200).astype(np.uint64) + np.uint64((1 << bits) - 41)  # one cluster at the table's end
    hot = np.full(100_000, spread[0])
    parts = [np.r_[spread[:200], hot], np.r_[spread[100:], crowded], crowded, spread[:1], spread[:0]]
    whole = f.build(parts[0], bits)
    for p in parts[1:]:
        whole = whole.merge(f.from_bytes(f.build(p, bits).to_bytes(), bits))
    values, counts = whole.entries()
    assert dict(zip(values.tolist(), counts.tolist(), strict=True)) == Counter(np.concatenate(parts).tolist())
    assert (np.diff(values.astype(object)) > 0).all()
    # remainders are stored, quotients are not: they follow from the place of the run
    assert whole.value.max() < 1 << whole.r_bits and whole.q_bits >= 8
    assert ((whole.meta & exact_dedup.OCCUPIED) != 0).sum() == len(set((values >> np.uint64(whole.r_bits)).tolist()))


def test_repeated_fingerprints_in_shards(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "FLUSH", 50)
    values = [k * 37 % 5000 for k in range(400)] + [7] * 300 + [4999, 4999, None, None]
    fps = spark.createDataFrame([(v,) for v in values], "x bigint").repartition(5)
    for shard_bits in (0, 3):
        got = sorted(r.fp for r in exact_dedup.repeated_fingerprints(fps, "x", 13, shard_bits).collect())
        assert got == sorted(v for v in set(values) - {None} if values.count(v) > 1)


def jaccard_brute(rows, t=80):
    sets = {}
    for i, text, _ in rows:
        if i is not None:
            w = words(text)
            sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= t * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies(seed, families, size, edits):
    rng = random.Random(seed)
    rows, i = [], 100
    for _ in range(families):
        base = prose(rng, rng.choice([8, 60, 200])).split()
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) * edits // 100))):
                w[rng.randrange(len(w))] = "edit" + str(rng.randint(0, 5))
            rows.append((i, " ".join(w), None))
            i += 1
    return rows


@pytest.mark.parametrize("tree_points,common", [(1024, 50), (4, 3)])
def test_similar_sets(spark, docs_of, odd_rows, monkeypatch, tree_points, common):
    monkeypatch.setattr(jaccard_join, "TREE_POINTS", tree_points)
    monkeypatch.setattr(jaccard_join, "COMMON", common)
    rows = odd_rows + near_copies(3, 6, 25, 4)
    got = jaccard_join.similar_sets(docs_of(rows)).collect()
    want = jaccard_brute(rows)
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert len({c for _, c in want.values()}) < len(want) - 20


def test_similar_sets_of_nothing(spark, docs_of):
    assert jaccard_join.similar_sets(docs_of([])).count() == 0
    got = jaccard_join.similar_sets(docs_of([(1, None, None), (2, "", None)])).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 1), (2, 0, 2)]
    left = jaccard_join.drop_near_copies(docs_of([(1, "a b c", None), (2, "A  b c", None), (3, None, None)]))
    assert sorted(r.doc_id for r in left.collect()) == [1, 3]


def test_rtree_finds_all_pairs_within_the_bound():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 9, (12, jaccard_join.COARSE))
    points = np.maximum(0, np.repeat(base, 10, axis=0) + (rng.random((120, jaccard_join.COARSE)) < 0.1)).astype(np.uint16)
    sizes, labels = points.sum(axis=1).astype(np.int64), rng.integers(0, 30, 120)
    i, j = jaccard_join.RTree(points, sizes, labels).search(80)
    got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)}
    assert len(got) == len(i)
    low = np.minimum(points[:, None], points[None]).sum(axis=2, dtype=np.int64)
    want = {(a, b) for a in range(120) for b in range(a) if labels[a] != labels[b] and low[a, b] * 180 >= 80 * (sizes[a] + sizes[b])}
    assert got == {(b, a) for a, b in want}


def covered_brute(rows, length=50):
    first, out = {}, defaultdict(set)
    for i, text, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = words(text)
        for k in range(len(w) - length + 1):
            if first.setdefault(tuple(w[k : k + length]), i) != i:
                out[i].update(range(k, k + length))
    return out


def test_repeated_passages(spark, docs_of, odd_rows):
    rng = random.Random(9)
    shared = [prose(rng, 60) for _ in range(3)]
    rows = odd_rows + [(200 + k, f"{prose(rng, 70)} {shared[k % 3]} {prose(rng, 30)}", None) for k in range(24)]
    got = substring_dedup.repeated_passages(docs_of(rows)).collect()
    text = {i: words(t) for i, t, _ in rows if i is not None}
    spans = defaultdict(set)
    for r in got:
        assert r.source_id < r.doc_id and r.end_word - r.start_word >= 50 and r.similarity >= 0.8
        spans[r.doc_id].update(range(r.start_word, r.end_word))
        if r.similarity == 1:
            assert text[r.doc_id][r.start_word : r.end_word] == text[r.source_id][r.source_start : r.source_start + r.end_word - r.start_word]
    want = covered_brute(rows)
    assert all(want[i] <= spans[i] for i in want)
    assert set(spans) - set(want) <= {2}  # the edited copy
    assert substring_dedup.repeated_passages(docs_of([])).count() == 0


def test_repeated_passages_with_insertions_and_deletions(spark, docs_of):
    rng = random.Random(12)
    rows, spots = [], {}
    for k in range(12):
        base = prose(rng, 90 if k % 3 < 2 else 500).split()
        copy = list(base)
        if k % 3 == 0:
            copy.insert(45, "inserted")
        elif k % 3 == 1:
            del copy[45]
        else:
            for at in range(490, 0, -49):
                copy.insert(at, "inserted")
        head = prose(rng, 70)
        rows += [(2 * k, f"{prose(rng, 40)} {' '.join(base)} {prose(rng, 30)}", None), (2 * k + 1, f"{head} {' '.join(copy)} {prose(rng, 20)}", None)]
        spots[2 * k + 1] = (70, 70 + len(copy))
    text = {i: words(t) for i, t, _ in rows}
    got = substring_dedup.repeated_passages(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.start_word, r.end_word) for r in got) == sorted((i, *span) for i, span in spots.items())
    for r in got:
        x = text[r.doc_id][r.start_word : r.end_word]
        y = text[r.source_id][r.source_start : r.source_start + (500 if r.doc_id % 6 == 5 else 90)]
        a, b = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in (x, y))
        assert r.similarity >= 0.8 and abs(r.similarity - len(a & b) / len(a | b)) < 1e-9


def test_passages_about_a_common_sentence(spark, docs_of):
    """A sentence shorter than a passage that all documents hold doesn't hide the passages that some share about it."""
    rng = random.Random(15)
    sentence, rows = prose(rng, 45), []
    for k in range(60):
        rows.append((k, f"{prose(rng, 30)} {sentence} {prose(rng, 30)}", None))
    for k in range(12):
        before, after = prose(rng, k % 9), prose(rng, 8 - k % 9)
        rows += [(100 + 2 * k + n, f"{prose(rng, 25)} {before} {sentence} {after} {prose(rng, 25)}", None) for n in (0, 1)]
    rng.shuffle(rows)
    spans = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs_of(rows)).collect():
        spans[r.doc_id].update(range(r.start_word, r.end_word))
    want = covered_brute(rows)
    assert len(want) == 12 and all(want[i] <= spans[i] for i in want)
    assert set(spans) == set(want)


@pytest.mark.parametrize("min_words", [8, 50, 1200])
def test_passages_of_any_least_length(spark, docs_of, min_words):
    rng = random.Random(min_words)
    shared = prose(rng, min_words + 4)
    rows = [(k, f"{prose(rng, 60)} {shared if k % 2 else prose(rng, 40)} {prose(rng, 60)}", None) for k in range(6)]
    got = substring_dedup.repeated_passages(docs_of(rows), min_words=min_words).collect()
    spans = defaultdict(set)
    for r in got:
        spans[r.doc_id].update(range(r.start_word, r.end_word))
    want = covered_brute(rows, min_words)
    assert set(want) == {3, 5} and all(want[i] <= spans[i] for i in want)


@pytest.mark.parametrize("size,edits", [(60, 1), (120, 2), (200, 3)])
def test_recall_of_edited_passages(spark, docs_of, size, edits):
    """Of 200 passages with words replaced 0.95 are found, 0.9 nearly whole."""
    rng, rows = random.Random(21 + size), []
    for k in range(200):
        base = prose(rng, size).split()
        copy = list(base)
        for at in rng.sample(range(size), edits):
            copy[at] = "edited"
        rows += [(2 * k, f"{prose(rng, 40)} {' '.join(base)}", None), (2 * k + 1, f"{prose(rng, 30)} {' '.join(copy)} {prose(rng, 20)}", None)]
    spans = defaultdict(set)
    for r in substring_dedup.repeated_passages(docs_of(rows)).collect():
        spans[r.doc_id].update(range(r.start_word, r.end_word))
    planted = set(range(30, 30 + size))
    whole = sum(len(spans[2 * k + 1] & planted) >= 0.9 * size for k in range(200))
    some = sum(bool(spans[2 * k + 1] & planted) for k in range(200))
    assert (some >= 190 and whole >= 180 and not any(spans[2 * k] for k in range(200))), (some, whole)


def morse(n: int, one: str = "a", other: str = "b") -> str:
    return "".join(one if bin(k).count("1") % 2 else other for k in range(n))


@pytest.mark.parametrize("n", [256, 2048])
def test_thue_morse_words_are_told_apart(spark, docs_of, n):
    """Words whose power sums modulo 2**64 are equal are no copies of one another."""
    rng = random.Random(n)
    a, b = morse(n), morse(n, "b", "a")
    x, y = (" ".join([*prose(rng, 3).split(), *[w] * 2]) for w in (a, b))
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_sets(docs_of([(1, a, None), (2, b, None), (3, x, None), (4, y, None), (5, a.upper(), None)])).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    long = [prose(rng, 70).split() for _ in range(2)]
    one, two = (" ".join(w if k % 2 else x for k, x in enumerate(long[0])) for w in (a, b))
    found = substring_dedup.repeated_passages(docs_of([(1, one, None), (2, two, None), (3, f"{prose(rng, 9)} {one}", None)])).collect()
    assert [(r.doc_id, r.source_id) for r in found] == [(3, 1)]


def test_pairs_are_verified_on_words(spark, docs_of, monkeypatch):
    """Where hashes of words collide, sets are compared as words."""
    from curata.llm import kernels

    rows = [(1, "a b c d e f", None), (2, "a b c d e g", None), (3, "a b c d e", None), (4, "A b c  d e f", None), (5, "x", None), (6, "y", None)]
    text = kernels.Words(*kernels.buffers(kernels.pa.array([t for _, t, _ in rows], kernels.pa.large_string())))
    raw, _ = text.shingles()
    assert text.distinct(raw)
    text.hash[:] = 7
    assert not text.distinct(text.shingles()[0])
    flat = jaccard_join.Words

    class Blind(flat):
        def _hashed(self, letters):
            return np.full(len(self.start), 7, np.uint64)

    pairs = [(1, 2), (1, 4), (5, 6), (1, 3)]
    by_id = {i: t for i, t, _ in rows}
    table = kernels.pa.RecordBatch.from_arrays([kernels.pa.array(c) for c in zip(*[(x, y, by_id[x], by_id[y]) for x, y in pairs], strict=True)], ["a", "b", "a_text", "b_text"])
    want = [{"a": 1, "b": 4}]
    assert [r for b in jaccard_join._verify(80, 5)(iter([table])) for r in b.to_pylist()] == want
    monkeypatch.setattr(jaccard_join, "Words", Blind)
    assert [r for b in jaccard_join._verify(80, 5)(iter([table])) for r in b.to_pylist()] == want


@pytest.mark.parametrize("turned", [False, True])
def test_one_id_with_two_texts(spark, docs_of, turned):
    """Texts of one id are documents of their own: each loses what is repeated in it and nothing else."""
    rng = random.Random(31)
    shared, alone, short = prose(rng, 80), prose(rng, 400), prose(rng, 12)
    other = f"{prose(rng, 300)} {shared} {prose(rng, 20)}"
    rows = [(1, f"{prose(rng, 30)} {shared}", None), (2, alone, None), (2, other, None), (2, short, None), (3, f"{shared} {short}", None), (4, alone, None), (5, None, None), (2, other, None)]
    rows = rows[::-1] if turned else rows
    docs = docs_of(rows).repartition(3)
    found = substring_dedup.repeated_passages(docs).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.source_id) for r in found} >= {(2, 300, 380, 1), (4, 0, 400, 2)}
    left = sorted((r.doc_id, len(words(r.text))) for r in substring_dedup.cut_repeats(docs).collect())
    assert left == [(1, 110), (2, 12), (2, 320), (2, 320), (2, 400), (3, 12), (5, 0)]
    both = [(1, shared, None), (1, f"{shared} more", None)]
    assert sum(len(words(r.text)) for r in substring_dedup.cut_repeats(docs_of(both)).collect()) in (80, 81)


def test_cut_repeats(spark, docs_of):
    rng = random.Random(4)
    shared, a, b = prose(rng, 55), prose(rng, 20), prose(rng, 20)
    rows = [(1, f"{a} {shared}", "en"), (2, f"{b}\n{shared}  tail", "en"), (3, shared, "en"), (4, None, None), (5, "", "x")]
    out = substring_dedup.cut_repeats(docs_of(rows))
    assert out.columns == docs_of(rows).columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: (f"{b}\n  tail", len(b) + 7), 4: (None, None), 5: ("", 0)}


def test_cartesian_windows():
    x = [5, 3, 8, 1, 9, 2]
    left, right = substring_dedup.cartesian_windows(x)
    for i, v in enumerate(x):
        assert left[i] == max((k for k in range(i) if x[k] < v), default=-1) and right[i] == min((k for k in range(i + 1, 6) if x[k] < v), default=6)
    y = np.random.default_rng(1).integers(0, 99, 57).astype(np.uint64)
    assert (substring_dedup.sliding_minima(y, 7) == [y[i : i + 7].min() for i in range(51)]).all()


def test_ids_need_no_order(spark, docs_of):
    rows = near_copies(8, 2, 6, 3)
    a = jaccard_join.similar_sets(docs_of(rows)).orderBy("doc_id").collect()
    b = jaccard_join.similar_sets(docs_of(rows[::-1]).repartition(5, F.rand(1))).orderBy("doc_id").collect()
    assert a == b
