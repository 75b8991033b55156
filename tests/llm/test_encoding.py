"""Packing, sampled pieces, fingerprints and the pipeline."""

import hashlib
import random
import zlib
from collections import Counter
from math import exp

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import fingerprint, oracles, packing, piece_sampling, queries
from curata.llm.kernels import mix
from curata.llm.tables import tokenizer_path

BPE = tokenizer_path("byte_bpe_50k.json")
PIECES = tokenizer_path("piece_bpe_32k.model")


@pytest.mark.parametrize("text", ["a  b\n\n c\t", "it's <|endoftext|> x", "½ ² café  x  \n", "_a_ 12'LL 'll'", "\x1c a \x1f", "   ", "", '"é×÷µ"', "a\r\n  b", " 'sx", "日本 😀", "x" * 9000])
def test_encoder_equals_the_library(text):
    enc = packing.encoder(BPE)
    assert enc(text) == enc(text) == enc.encode(text)


def test_packing_round_trip(spark, docs_of, odd_rows):
    enc = packing.encoder(BPE)
    want = Counter(np.frombuffer(enc(t or "") + b"\1\0\0\0", np.int32).tobytes() for _, t, _ in odd_rows)
    pieces = packing.pack(docs_of(odd_rows), BPE).collect()
    assert all(p.length & (p.length - 1) == 0 and p.length <= 2048 and p.offset == 0 and len(p.ids) == p.length for p in pieces)
    assert all(zlib.crc32(np.array(p.ids, "<u4").tobytes()) == p.ids_crc32 for p in pieces)
    assert len({p.sequence_id for p in pieces}) == len(pieces)
    got, now = Counter(), []
    for p in sorted(pieces, key=lambda p: p.sequence_id):
        assert p.start == len(now)
        now += p.ids
        if len(now) == p.doc_tokens:
            got[np.array(now, np.int32).tobytes()] += 1
            now = []
    assert got == want and not now
    assert packing.pack(docs_of([]), BPE).count() == 0


def test_decompose():
    for n in [1, 2, 3, 2047, 2048, 2049, 7000]:
        parts = packing.decompose(n, 2048)
        assert sum(parts) == n and all(p & (p - 1) == 0 for p in parts) and parts == sorted(parts, reverse=True)


def test_pieces_are_lossless_and_seeded(spark, docs_of, odd_rows):
    rows = [r for r in odd_rows if r[0] is not None]
    a = piece_sampling.sample_pieces(docs_of(rows), PIECES, seed=3)
    back = piece_sampling.decode_pieces(a, PIECES)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((i, t or "") for i, t, _ in rows)
    ids = lambda df: {r.doc_id: r.ids for r in df.collect()}
    assert ids(a) == ids(piece_sampling.sample_pieces(docs_of(rows[::-1]).repartition(3, F.rand(2)), PIECES, seed=3))
    assert ids(a) != ids(piece_sampling.sample_pieces(docs_of(rows), PIECES, seed=4))
    odd = piece_sampling.sample_pieces(docs_of(odd_rows), PIECES, digest=True).collect()
    assert len(odd) == len(odd_rows) and all(r.lossless for r in odd)
    assert piece_sampling.sample_pieces(docs_of([]), PIECES).count() == 0


def test_pieces_follow_the_lattice():
    m = piece_sampling.PieceModel(PIECES)
    word = piece_sampling.META + "the"

    def paths(i):
        if i == len(word):
            yield (), 0.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in m.weights:
                for rest, w in paths(j):
                    yield (m.weights[word[i:j]][0], *rest), w + 0.3 * m.weights[word[i:j]][1]

    mass = {p: exp(w) for p, w in paths(0)}
    total = sum(mass.values())
    got = Counter(tuple(x.tolist()) for x in m.sample(["the"] * 6000, mix(np.arange(6000, dtype=np.uint64)), 0, 0.3))
    for p, w in mass.items():
        assert abs(got[p] / 6000 - w / total) < 0.03


def test_files_of_another_kind_go_to_the_library(tmp_path):
    import json
    from pathlib import Path

    spec = json.loads(Path(tokenizer_path("byte_bpe_50k.json")).read_text(encoding="utf-8"))
    assert packing.restated(spec)
    text = "Hello there, it's 12 o'clock  and all\nis well"
    for name, change in {"lower": {"normalizer": {"type": "Lowercase"}}, "spaced": {"pre_tokenizer": spec["pre_tokenizer"] | {"add_prefix_space": True}}, "whole": {"pre_tokenizer": spec["pre_tokenizer"] | {"use_regex": False}}}.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | change), encoding="utf-8")
        enc = packing.Encoder(str(path))
        assert not enc.restated and enc(text) == enc.encode(text)
    assert packing.Encoder(tokenizer_path("byte_bpe_50k.json"))(text) == packing.Encoder(tokenizer_path("byte_bpe_50k.json")).encode(text)


def test_edit_likeness_against_plain_sums(spark, docs_of):
    """near_edited and near_next follow from counts of signed shingles, summed by loops."""
    rng = random.Random(8)
    texts = ["\n".join(" ".join(rng.choice(["a", "bb", "ccc", "dd", "e"]) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 6))) for _ in range(12)]
    got = {r.doc_id: r for r in fingerprint.edit_likeness(docs_of([(k, t, None) for k, t in enumerate(texts)])).collect()}

    def lanes(text):
        out = np.zeros(fingerprint.NEAR)
        for line in text.split("\n"):
            w = fingerprint.Words(np.frombuffer(line.encode(), np.uint8), np.array([0, len(line)]))
            for g in w.shingles(fingerprint.GRAM)[0].tolist():
                out[g % fingerprint.NEAR] += -1 if g >> 63 else 1
        return out

    for k, t in enumerate(texts):
        after = texts[(k + 1) % len(texts)]
        for value, other in ((got[k].near_edited, fingerprint.edited_text(t, after)), (got[k].near_next, after)):
            x, y = lanes(t), lanes(other)
            norm = np.sqrt((x * x).sum() * (y * y).sum())
            want = 1.0 if sorted(t.split("\n")) == sorted(other.split("\n")) else max(0.0, float(x @ y) / max(norm, 1.0))
            assert abs(value - min(1.0, want)) < 1e-9


def test_long_words_keep_their_whole_lattice():
    """A word without a space far beyond any stretch: at a low temperature the draw is the best path of the whole word."""
    m = piece_sampling.PieceModel(PIECES)
    rng = random.Random(3)
    word = piece_sampling.META + "".join(rng.choice(["the", "ing", "er", "on", "ation", "pre", "q", "z"]) for _ in range(500))
    best, back = [0.0] + [-float("inf")] * len(word), [0] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - m.longest), j):
            w = m.weights.get(word[i:j], (0, m.spelt if j - i == 1 else -float("inf")))[1]
            if best[i] + w > best[j]:
                best[j], back[j] = best[i] + w, i
    score = {v[0]: v[1] for v in m.weights.values()}
    ids = m.sample([word[1:]], mix(np.arange(1, dtype=np.uint64)), 0, 500.0)[0]
    assert abs(sum(score[int(i)] for i in ids) - best[-1]) < 0.05 and len(word) > 1200
    assert m.decode(ids) == word[1:]


def test_repeats_beyond_any_lane_width():
    many = " ".join(["a b c"] * 40_000)
    wide, near = fingerprint._vectors([many])
    assert np.abs(near[0].astype(np.int64)).max() > 1 << 15
    once = fingerprint.likeness((wide, near), fingerprint._vectors([many + " d"]))
    assert once[0] > 0.99


def test_fingerprints_add_up():
    a, b = "one two three\nfour five six\n", "seven eight nine ten"
    vec = lambda t: fingerprint._vectors([t])
    both = fingerprint.add(vec("one two three"), vec("four five six"))
    whole = vec("four five six\none two three")
    assert all((x == y).all() for x, y in zip(both, whole, strict=True))
    left = fingerprint.add(whole, vec("one two three"), -1)
    assert all((x == y).all() for x, y in zip(left, vec("four five six"), strict=True))
    assert not (vec(a)[0] == vec(b)[0]).all() and fingerprint.likeness(vec(a), vec(a))[0] == 1
    wide, near = fingerprint.decode(fingerprint.encode(*vec(a))[0])
    assert (wide == vec(a)[0][0]).all() and (near == vec(a)[1][0]).all()


def test_equal_fingerprints_say_equal_paragraphs(docs_of):
    """Paragraphs whose power sums modulo 2**64 are equal have vectors of their own; the order of paragraphs doesn't count."""
    for n in (256, 2048):
        a = "".join("ab"[bin(k).count("1") % 2] for k in range(n))
        b = a.translate(str.maketrans("ab", "ba"))
        rows = [(1, a, None), (2, b, None), (3, f"{a}\n{b}", None), (4, f"{b}\n{a}", None), (5, f"{a}\n{a}", None), (6, f"{b}\n{b}", None)]
        got = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs_of(rows)).collect()}
        assert got[3] == got[4] and len(set(got.values())) == 5
        wide, _ = fingerprint.decode(got[1])
        other, _ = fingerprint.decode(got[2])
        assert (wide != other).all()


@pytest.mark.parametrize("range_rows", [2000, 3])
def test_edit_likeness(spark, docs_of, odd_rows, monkeypatch, range_rows):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", range_rows)
    rows = odd_rows
    got = fingerprint.edit_likeness(docs_of(rows)).collect()
    chain = sorted(((-(1 << 63) if i is None else i, t or "") for i, t, _ in rows))
    want = Counter()
    for (i, t), (_, after) in zip(chain, chain[1:] + chain[:1], strict=True):
        half = len(t) // 2
        want[None if i < 0 else i, len(t), hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    own = {r.doc_id: r for r in got}
    assert own[0].fingerprint == own[1].fingerprint != own[2].fingerprint and own[0].near_next == 1
    plain = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs_of(rows)).collect()}
    assert all(r.fingerprint == plain[r.doc_id] for r in got if r.doc_id is not None)
    assert fingerprint.edit_likeness(docs_of([])).count() == 0


def test_likeness_tells_edits_from_others(spark, sf_dir):
    out = fingerprint.edit_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("n_chars > 300")
    assert out.filter("near_edited > near_next").count() >= 0.95 * out.count()


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    from oracle import compare

    compare(spark, queries.queries()[name], oracles.oracle_sql()[name], sf_dir)


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_pipeline(spark, docs_of, odd_rows, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    shared = " ".join(f"w{rng.randrange(999)}" for _ in range(60))
    rows = odd_rows + [(300 + k, f"own{k} " * 20 + " ".join(f"v{rng.randrange(99999)}" for _ in range(50)) + " " + shared, "en") for k in range(3)]
    docs_of(rows).write.parquet(str(tmp_path / "documents.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(out)
        docs = spark.read.parquet(out)
        assert docs.columns == docs_of(rows).columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert not {3, 4, 5, 10} & set(kept["language"])
    assert 1 not in kept["exact_dedup"] and 0 in kept["exact_dedup"]
    assert not {2, 13} & set(kept["jaccard_join"]) and 6 in kept["jaccard_join"] and 7 not in kept["jaccard_join"]
    last = kept["substring_dedup"]
    assert shared in last[300] and shared not in last[301] and last[301].startswith("own1") and 20 in last
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert pieces.select("doc_id").distinct().count() == len(last)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == pieces.count()
