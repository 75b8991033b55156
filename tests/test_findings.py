"""Faults that reviews of the queries found: each test failed before its finding was mended."""

import sys
from pathlib import Path
from unittest.mock import MagicMock

import numpy as np
import pyarrow as pa
import pytest
from oracle import compare
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm import jaccard_join, language_id, packing, piece_sampling, substring_dedup
from curata.llm.scratch import BATCH_BYTES, BATCH_SETTING, JOIN_SETTINGS
from curata.llm.tables import tokenizer_path
from curata.operators import classify, hamming_index
from curata.plans import catalog
from curata.streaming import stateful


@pytest.fixture
def planted(spark, sf_dir, tmp_path):
    """A folder of the tables of which one is given rows."""

    def plant(name: str, rows, schema: str) -> str:
        for other in Path(sf_dir).iterdir():
            if other.name != f"{name}.parquet":
                (tmp_path / other.name).symlink_to(other)
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return plant


def test_answers_that_begin_with_a_value_are_no_json(spark, planted):
    """Texts whose first word is a number, a string or a list, and objects with something after them, equal the SQL."""
    texts = ["4703 words", "-1.5e3, 2", '"a" b', "[1] 2", "1], 0]", "true or not", "null", "12", '"a"', "[1]", "[]", '{"detectedTags": ["a"]} x', '{"detectedTags": ["a"]}', "", None]
    rows = [(12 * k + 2, t, "de", "src0", len(t or "")) for k, t in enumerate(texts)]
    assert compare(spark, catalog.queries()["answer_faults"], catalog.oracle_sql()["answer_faults"], planted("documents", rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")) == len(texts)
    raw = spark.createDataFrame([(t,) for t in texts], "raw string")
    assert [r.fault for r in raw.select(classify.answer_fault(F.col("raw")).alias("fault")).collect()] == ["no JSON"] * 6 + ["no object"] * 5 + [None] * 2 + ["empty"] * 2


def test_spread_hashes_are_never_broadcast(spark):
    """Neither by the plan nor by adaptive execution, which sees what was there before the hashes are spread."""
    reps = spark.range(300).select(F.xxhash64("id").alias("phash"), F.col("id").alias("p"))
    found = hamming_index.pairs_within(reps, 10)
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def _even(n: int) -> list[int]:
    import random

    rng = random.Random(n)
    return sorted({rng.getrandbits(64) - (1 << 63) for _ in range(n)})


@pytest.mark.parametrize("size", [1 << 15, 100])
def test_even_hashes_are_compared_in_blocks(spark, monkeypatch, size):
    """Hashes without a neighbourhood: no row for each hash and ring, sums and links of blocks, in one block and in many; copies count."""
    monkeypatch.setattr(hamming_index, "BLOCK", size)
    monkeypatch.setattr(hamming_index, "AT_ONCE", 1 << 10)
    values = _even(700)
    near = {(i, j): d for i in range(len(values)) for j in range(i + 1, len(values)) if (d := ((values[i] ^ values[j]) & (1 << 64) - 1).bit_count()) <= 19}
    reps = spark.createDataFrame([(v, f"/{k:04d}", k % 3 + 1) for k, v in enumerate(values)], "phash bigint, p string, c int")
    pairs = hamming_index.pairs_within(reps, 19)
    assert sorted((r.p1, r.p2, r.bits) for r in pairs.collect()) == sorted((f"/{i:04d}", f"/{j:04d}", d) for (i, j), d in near.items())
    assert "visits" not in pairs._jdf.queryExecution().toString()
    links = hamming_index.links_within(reps, 19).collect()
    weight = {ij: (ij[0] % 3 + 1) * (ij[1] % 3 + 1) for ij in near}
    assert sum(r.n for r in links) == sum(weight.values()) and sum(r.bits for r in links) == sum(near[ij] * w for ij, w in weight.items())
    assert _parts({(r.phash, r.other) for r in links}) == _parts({(values[i], values[j]) for i, j in near})


def _parts(links: set) -> set:
    parts = {v: {v} for ends in links for v in ends}
    for a, b in links:
        if parts[a] is not parts[b]:
            parts[a] |= parts[b]
            for v in parts[b]:
                parts[v] = parts[a]
    return {frozenset(p) for p in parts.values()}


def test_retries_of_many_requests_are_few_buckets(spark, tmp_path):
    """Repeated and null names, and requests that wait for different times, in buckets that many share."""
    rows = [(str(k % 300) if k % 300 else None, "s", "image", str(k % 300), "p") for k in range(600)]
    schema = "request_id string, session_id string, kind string, image_path string, prompt string"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    ends = stateful.retried(stream, catalog.CountedFailures(), buckets=5)
    got = stateful.await_rows(stateful.write_batches(ends, str(tmp_path / "out"), str(tmp_path / "mark"), "update"), ends, str(tmp_path / "out"), 300, 60).collect()
    want = {k: ("error", 1) if k % 7 == 0 else ("exhausted", 4) if k % 6 >= 4 else ("classified", k % 6 + 1) for k in range(300)}
    assert len(got) == 300 and {int(r.request_id or 0): (r.state, r.attempts) for r in got} == want


@pytest.mark.parametrize("by", ["pipeline", "operator"])
def test_texts_go_to_python_in_small_batches(spark, tmp_path, by):
    """Neither the pipeline, from its first stage on, nor the Jaccard join hands thousands of whole texts to a worker at once."""
    import corpus_pipeline

    docs = spark.range(0, 3000, 1, 1).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id", F.repeat(F.lit(" word"), 2000)).alias("text"), F.lit("en").alias("lang"))
    few = docs.limit(5)

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    spark.conf.unset(BATCH_SETTING)
    try:
        (corpus_pipeline.language(spark, few, str(tmp_path)) if by == "pipeline" else jaccard_join.similar_sets(few)).collect()
        found = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(found) == 3000 and max(found) <= 2 * BATCH_BYTES // 10_000
        spark.conf.set(BATCH_SETTING, "16m")
        jaccard_join.similar_sets(few)
        assert spark.conf.get(BATCH_SETTING) == "16m"
    finally:
        spark.conf.unset(BATCH_SETTING)


def test_the_pipeline_broadcasts_no_table_for_being_small(spark, tmp_path, monkeypatch):
    """Small tables aren't built in the driver's memory by the dozen; run leaves the session's joins as they were."""
    import corpus_pipeline

    rows = [(k, f"the text {k % 4}", "en", "s", 10) for k in range(8)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    try:
        found = corpus_pipeline.copies(spark, corpus_pipeline.language(spark, docs, str(tmp_path)), str(tmp_path))
        assert {r.doc_id for r in found.collect()} == {0, 1, 2, 3}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
        spark.conf.set(JOIN_SETTINGS[0], "3m")
        spark.conf.unset(JOIN_SETTINGS[1])
        monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], corpus_pipeline.STAGES[-1]])
        assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 8
        assert spark.conf.get(JOIN_SETTINGS[0]) == "3m" and JOIN_SETTINGS[1] not in spark.conf.getAll
    finally:
        for name in (*JOIN_SETTINGS, BATCH_SETTING):
            spark.conf.unset(name)


def test_requests_are_no_pandas_rows(spark):
    """Columns pass as they came, and a connector gets whole numbers and nulls, not floats and NaN."""

    class Shows:
        def process(self, request):
            if request["n"] == 3:
                raise ValueError
            return "ok", repr((request["n"], request["image_path"], request["attempt"], request["system_prompt"] == classify.SYSTEM_PROMPT))

    schema = "session_id string, kind string, image_path string, prompt string, n bigint, at timestamp, tags array<string>, size double"
    rows = [("s", "image", "/a", "p", 1, None, ["x", None], None), ("s", "text", None, None, None, None, None, 0.5), ("s", "image", None, "p", 2, None, [], 1.5), ("s", "image", "/b", "p", 3, None, None, None)]
    asked = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_seconds("n")).withColumn("attempt", F.lit(0)).coalesce(1)
    out = classify.process(asked, Shows())
    assert "MapInPandas" not in out._jdf.queryExecution().toString() and out.columns == [*asked.columns, "status", "raw"]
    got = out.collect()
    assert [tuple(r)[:-2] for r in got] == [tuple(r) for r in asked.collect()]
    assert [(r.status, r.raw) for r in got] == [("ok", "(1, '/a', 0, True)"), ("ok", "(None, None, 0, False)"), ("retry", None), ("retry", None)]


def test_texts_with_little_in_common_are_not_aligned(monkeypatch):
    """36 common shingles are no passage of 46 at 80 percent, and no run is looked for; 37 with 9 replaced are one at 66 percent."""
    x, y = np.arange(100, dtype=np.uint32), np.arange(1000, 1100, dtype=np.uint32)
    near = y.copy()
    near[20:66] = np.where(np.arange(46) % 5 == 4, near[20:66], x[20:66])
    assert substring_dedup.aligned_passages(x, near, [0], 46, 66) == [(20, 66, 20, 37 / 55)]
    monkeypatch.delattr(substring_dedup, "_runs")
    near = y.copy()
    near[20:56] = x[20:56]
    assert substring_dedup.aligned_passages(x, near, [0], 46, 80) == []


def test_the_language_is_predicted_once_and_by_one_kind_of_worker(spark, monkeypatch):
    """Neither the filter on the prediction nor the sample's keys take Python workers of their own."""
    import pyspark

    rows = [(k, "the cat sat on the mat" if k % 2 else "der hund lag auf dem tisch", ["de", "en", None][k % 2 if k < 8 else 2]) for k in range(12)]
    docs = spark.createDataFrame([*rows, (12, "12", None), (13, None, "en")], "doc_id bigint, text string, lang string").localCheckpoint()
    monkeypatch.setattr(pyspark.SparkContext, "parallelize", None)
    found = language_id.keep_identified(docs)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert {r.doc_id: r.lang for r in found.collect()} == {k: "en" if k % 2 else "de" for k in range(12)}


def test_idle_packing_workers_keep_no_memo(monkeypatch):
    """What a task has memoized goes when it ends, with its pieces as before."""
    seen = {}

    class Docs:
        schema = {"doc_id": T.StructField("doc_id", T.LongType())}

        def select(self, *columns):
            return self

        def mapInArrow(self, fn, schema):
            batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["two words", None])], ["doc_id", "text"])
            seen["rows"] = [r for b in fn(iter([batch])) for r in b.to_pylist()]
            return self

    monkeypatch.setattr(packing, "F", MagicMock())
    packing.pack(Docs(), tokenizer_path("byte_bpe_50k.json"))
    whole = packing.encoder(tokenizer_path("byte_bpe_50k.json"))
    assert [r["ids"] for r in seen["rows"] if r["doc_id"] == 2] == [[1]]
    assert sum((r["ids"] for r in seen["rows"] if r["doc_id"] == 1), []) == [*np.frombuffer(whole.encode("two words"), np.uint32).tolist(), 1]
    assert len(whole.memo) == 0


def test_pieces_are_drawn_without_a_call_for_each_word():
    """Words are cut, told apart and spelt in blocks: 20,000 words take far fewer calls than words; texts come back whole."""
    m = piece_sampling.piece_model(tokenizer_path("piece_bpe_32k.model"))
    texts = [" ".join(f"word{k}\té" for k in range(10_000)), "", "  two  spaces ▁ and ▁▁", "퟿\U0001f600"]
    calls = []
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    try:
        ids = m.sample(texts, np.arange(4, dtype=np.uint64), 1, 1.0)
    finally:
        sys.setprofile(None)
    assert len(calls) < 10_000
    assert [m.decode(x) for x in ids] == texts


def test_words_of_one_hash_are_told_apart(monkeypatch):
    """Numbers of distinct words are those of their characters, also where hashes agree; words are cut as by the pattern."""
    words = ["▁a", "▁b", "▁a", "▁▁cd", "▁", "▁b", "▁cd"]
    points = piece_sampling._points("".join(words))
    first = np.cumsum([0, *map(len, words)])
    for _ in range(2):
        chosen, number = piece_sampling.distinct_words(points, first)
        assert chosen.tolist() == [0, 1, 3, 4, 6] and number.tolist() == [0, 1, 0, 2, 3, 1, 4]
        monkeypatch.setattr(piece_sampling.Spans, "hash", lambda self, start, length: np.zeros(len(start), np.uint64))
    seen = []
    monkeypatch.setattr(piece_sampling.PieceModel, "draw", lambda self, points, first, seeds, alpha: (seen.extend("".join(map(chr, points[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)), (np.zeros(0, np.int64),) * 2)[1])
    texts = ["", " ", "a b", "  a  b  ", "x▁y ", "a\nb", "▁"]
    piece_sampling.PieceModel.sample(piece_sampling.piece_model(tokenizer_path("piece_bpe_32k.model")), texts, np.arange(len(texts), dtype=np.uint64), 1, 1.0)
    meta, literal = piece_sampling.META, piece_sampling._LITERAL
    assert seen == [w for t in texts for w in piece_sampling._WORD.findall(meta + t.replace(meta, literal).replace(" ", meta))]
