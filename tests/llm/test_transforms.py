"""Fill-in-the-middle, line dedup and periodic runs against brute force."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from oracle import compare
from pyspark.sql import functions as F

from curata.llm import fill_middle, line_dedup, oracles, periodic_runs, queries

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# fill in the middle


def middle_brute(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, len(units), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, len(units), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle(spark, docs_of, odd_rows):
    marks = [(100, "a <P> b", None), (101, "<<S", None), (102, "<S>", None), (103, "x<P", None), *[(110 + k, "<S<P<M>"[: k % 6] + "Ä<" * k, None) for k in range(60)]]
    rows = [*odd_rows, *marks, (200, "wörd 日本\n" * 30_000, None)]
    docs = docs_of(rows)
    out = fill_middle.fill_in_middle(docs)
    got = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((middle_brute(i, t) for i, t, _ in rows), key=repr)
    assert sorted((r.back for r in got)) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fill_middle.fill_in_middle(docs_of([])).count() == 0


def test_fill_in_middle_percentages(docs_of):
    docs = docs_of([(k, "one two three", None) for k in range(200)])
    forms = lambda **a: {r.form for r in fill_middle.fill_in_middle(docs, **a).select("form").distinct().collect()}
    assert forms(plain=100) == {"plain"} and forms(plain=0, spm=100) == {"spm"} and forms(plain=0, spm=0) == {"psm"}
    first, second = (fill_middle.fill_in_middle(docs, seed=s).agg(F.sum("prefix_chars")).first()[0] for s in (1, 2))
    assert first != second


def test_units_are_never_stored():
    text = "ab, " * 50_000
    assert fill_middle.count_units(text) == 150_000 and fill_middle.count_units("") == 0
    assert fill_middle.offsets(text, 0, 0) == (0, 0) and fill_middle.offsets(text, 0, 150_000) == (0, len(text))
    assert fill_middle.offsets(text, 4, 4) == (6, 6)
    import tracemalloc

    tracemalloc.start()
    fill_middle.count_units(text)
    fill_middle.offsets(text, 70_000, 140_000)
    assert tracemalloc.get_traced_memory()[1] < 50_000
    tracemalloc.stop()


# line dedup


def lines_brute(rows, min_chars=20, min_docs=3):
    """(id, lines, dropped, kept text) of each row."""
    low = lambda i: -(1 << 63) if i is None else i
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(fold)
    held = defaultdict(set)
    for i, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add(low(i))
    out = []
    for i, text, *_ in rows:
        lines = (text or "").split("\n")
        stay = [x for x in lines if len(held[key(x)]) < min_docs or max(held[key(x)]) == low(i)]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def line_rows(seed):
    rng = random.Random(seed)
    pool = [" ".join(rng.choice(["alpha", "BETA", "gämma", "x", "日本語"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    rows = []
    for i in range(150):
        lines = [rng.choice(["", " ", "\t"]) + rng.choice(pool) + rng.choice(["", "\r", " \x0b"]) for _ in range(rng.randint(0, 12))]
        lines += ["The very common line of all documents"] * rng.randint(0, 3) if i % 3 else []
        rows.append((i % 140, "\n".join(rng.choice([x, x.upper()]) if x.isascii() else x for x in lines), None))
    return rows


def kept_lines(docs):
    found = line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs), counts=("lines_before", "lines_gone"))
    return sorted(((r.doc_id, r.lines_before, r.lines_gone, r.text or "") for r in found.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 8, 100])
def test_line_dedup(spark, docs_of, odd_rows, parts):
    rows = [*odd_rows, *line_rows(parts), *[(None, "The very common line of all documents\nx", None)] * 3]
    was = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = docs_of(rows).repartition(5)
        assert kept_lines(docs) == lines_brute(rows)
        assert line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs)).columns == docs.columns
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)


def test_line_dedup_of_nothing(docs_of):
    assert kept_lines(docs_of([])) == []
    assert kept_lines(docs_of([(1, None, None), (2, "", None), (3, "\n", None)])) == [(1, 1, 0, ""), (2, 1, 0, ""), (3, 2, 0, "\n")]


def test_one_line_over_many_ranges(spark, docs_of):
    """A line that every document holds many times is settled across the ranges, also where one document fills several."""
    line = "a line that all of the documents hold"
    rows = [(i, "\n".join([line] * (400 if i in (7, 39) else 5) + [f"only the document {i} has it"]), None) for i in range(40)]
    spark.conf.set("spark.sql.shuffle.partitions", 37)
    try:
        assert kept_lines(docs_of(rows)) == lines_brute(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    few = [(i, "\n".join([line] * 300), None) for i in (1, 2)]
    assert kept_lines(docs_of(few)) == lines_brute(few)


@pytest.mark.parametrize("size", [1, 3, 10_000])
def test_streamed_lines_don_t_depend_on_batches(size):
    import pyarrow as pa

    rng = np.random.default_rng(size)
    n = 400
    cols = [np.sort(rng.integers(0, 60, n)), np.zeros(n, int), rng.integers(0, 5, n), rng.integers(0, 9, n), np.arange(n)]
    order = np.lexsort((cols[4], cols[3], -cols[2], cols[0]))
    cols = [c[order] for c in cols]
    names = ["h1", "h2", "doc", "line_row", "pos"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[a : a + size].astype(np.int32 if k == 4 else np.int64)) for k, c in enumerate(cols)], names) for a in range(0, n, size)]
    rows = [r for b in line_dedup._streamed(3)(iter(batches)) for r in b.to_pylist()]
    docs = defaultdict(set)
    for h, d in zip(cols[0].tolist(), cols[2].tolist(), strict=True):
        docs[h].add(d)
    tops = {h: max(r["doc"] for r in rows if r["kind"] == line_dedup.SUMMARY and r["h1"] == h) for h in {r["h1"] for r in rows if r["kind"] == line_dedup.SUMMARY}}
    assert len(tops) <= 2 and sum(r["kind"] == line_dedup.SUMMARY for r in rows) <= 6
    got = sorted(r["pos"] for r in rows if r["kind"] == line_dedup.GONE or (r["kind"] == line_dedup.OPEN and len(docs[r["h1"]]) >= 3 and r["doc"] != tops[r["h1"]]))
    assert got == sorted(p for h, d, p in zip(cols[0].tolist(), cols[2].tolist(), cols[4].tolist(), strict=True) if len(docs[h]) >= 3 and d != max(docs[h]))


def test_bitmaps_are_small():
    gone = list(range(5, 100_000))
    packed = line_dedup.pack_bits(100_000, gone)
    assert len(packed) < 100 and line_dedup.unpack_bits(packed, 100_000).sum() == 5


# periodic runs


def runs_brute(w, min_length=24, min_periods=3):
    n, out = len(w), []
    for q in range(1, n // min_periods + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            length = i - s + q
            if length >= max(min_length, min_periods * q) and not any(w[s : s + length - d] == w[s + d : s + length] for d in range(1, q)):
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def sequences(rng):
    for _ in range(rng.randint(1, 4)):
        n, kinds = rng.choice([0, 1, 5, 23, 24, 60, 150]), rng.choice([1, 2, 3, 20])
        w = [rng.randint(0, kinds) for _ in range(n)]
        if n and rng.random() < 0.6:
            a = rng.randrange(n)
            w = periodic_runs.repeated_tail(w, a, rng.randint(1, max(1, (n - a) // 2)))
        if n > 50 and rng.random() < 0.5:
            w = w[:20] + periodic_runs.repeated_tail(w[20:50], 0, rng.randint(1, 9)) + w[50:]
        yield w


@pytest.mark.parametrize("scanned", [1, 3, 24])
@pytest.mark.parametrize("least", [(24, 3), (2, 2), (6, 2), (3, 3)])
def test_runs_against_brute_force(monkeypatch, scanned, least):
    monkeypatch.setattr(periodic_runs, "SCANNED", scanned)
    rng = random.Random(scanned * 100 + sum(least))
    for _ in range(60):
        texts = list(sequences(rng))
        assert periodic_runs.find_runs(texts, *least) == [runs_brute(w, *least) for w in texts]


def test_words_of_runs():
    """Fibonacci, Thue-Morse and unary words: many runs, none of exponent over two, and one."""
    fib = ["a", "ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    morse = [f"{bin(k).count('1') % 2}" for k in range(512)]
    for w in (list(fib[-1]), morse, ["x"] * 700):
        assert periodic_runs.find_runs([w], 2, 2) == [runs_brute(w, 2, 2)]
    assert periodic_runs.find_runs([morse], 3, 3) == [[]]


def test_smaller_halves_only(monkeypatch):
    """All rounds together look at about n log n positions."""
    looked = []
    refine = periodic_runs.Classes.refine
    monkeypatch.setattr(periodic_runs.Classes, "refine", lambda self: (looked.append(len(self.recent)), refine(self))[1])
    rng = random.Random(3)
    words = [rng.randint(0, 400) for _ in range(20_000)]
    assert len(periodic_runs.find_runs([periodic_runs.repeated_tail(words, 2000, 3001)])[0]) == 1
    assert len(looked) > 2500 and sum(looked) < 20_000 * 15


def test_periodic_runs(docs_of, odd_rows):
    rows = [*odd_rows, (300, "a b c " * 8 + "A b c", None), (301, "la\x0cla " * 12, None), (302, "x " * 23, None), (303, "x y z " * 9, None)]
    got = periodic_runs.periodic_runs(docs_of(rows)).collect()
    assert len(got) == len(rows)
    want = []
    for i, text, _ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = runs_brute(w) if len(w) < 5000 else [(0, len(w) - (i == 9), 10)]
        gone = {k for s, n, p in runs for k in range(s + p, s + n)}
        want.append((i, len(w), runs, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(docs_of([])).count() == 0


def test_strongest_run():
    best = periodic_runs.strongest
    assert best([]) is None and best([(5, 30, 10), (9, 61, 20), (2, 30, 10), (2, 60, 20)]) == (9, 61, 20)
    assert best([(2, 60, 20), (2, 30, 10)]) == (2, 30, 10)


def test_op13_is_its_contract(spark, sf_dir):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    planted = 0
    for r in queries.op13_periodic_runs(spark, sf_dir).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", rows[r.doc_id].text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            a = (h // 10) % n
            p = 1 + (n - a) // (3 + (h // 10) % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        if n > 1500:
            continue
        runs = runs_brute(w)
        planted += bool(runs)
        gone = {k for s, k_, q in runs for k in range(s + q, s + k_)}
        top = max(runs, key=lambda x: (x[1] / x[2], -x[0], -x[2]), default=(None, None, None))
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{s},{k},{q}\n" for s, k, q in runs))
        assert r.collapsed_sha256 == sha(" ".join(x for k, x in enumerate(w) if k not in gone))
    assert planted > 5


@pytest.mark.parametrize("name", ["op11_streaming_fill_middle", "op12_range_line_dedup"])
def test_new_queries_equal_sql(spark, name):
    compare(spark, queries.queries()[name], oracles.oracle_sql()[name], "/root/testdata/sf0.01")
