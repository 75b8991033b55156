"""The queries opN_<name> of this subpackage: thin digests of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curata.llm import chat, exact_dedup, fill_middle, fingerprint, jaccard_join, language_id, line_dedup, packing, periodic_runs, piece_sampling, quality, substring_dedup, url_templates
from curata.llm.tables import read, tokenizer_path


#: Fixed values of the op5 contract.
URL_RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.link_quotes(read(spark, sf_dir, "conversations"))


def op2_sparse_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op3_power_of_two_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), with_ids=False)


def op4_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op5_path_template_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a page's label is that of the document with its id: good if of quality and not toxic
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good"))
    return url_templates.judge(read(spark, sf_dir, "pages"), labels, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op6_count_vector_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_sets(read(spark, sf_dir, "documents"))


def op7_compact_window_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op8_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_pieces(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), seed=7, alpha=1.0, digest=True)


def op9_quotient_filter_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"))


def op10_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edit_likeness(read(spark, sf_dir, "documents"))


def op11_streaming_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_middle.fill_in_middle(read(spark, sf_dir, "documents"), seed=1, plain=10, spm=20)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", _sha("output").alias("output_sha256"), _sha(back).alias("restored_sha256"))


def op12_range_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    bitmaps = line_dedup.keep_bitmaps(docs, min_chars=20, min_docs=3)
    kept = line_dedup.drop_lines(docs, bitmaps, counts=("n_lines", "n_dropped"))
    return kept.select("doc_id", "n_lines", "n_dropped", _sha(F.coalesce("text", F.lit(""))).alias("kept_sha256"))


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the words from some place on are a period that the contract names."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                texts = part.column(2).to_pylist()
                for i, h in enumerate(part.column(1).to_pylist()):
                    words = (texts[i] or "").encode().split() if h is not None and h % 10 == 0 else []
                    if words:
                        n, g = len(words), h // 10
                        start = g % n
                        texts[i] = b" ".join(periodic_runs.repeated_tail(words, start, 1 + (n - start) // (3 + g % 8))).decode()
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    hashed = docs.select("doc_id", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"), "text")
    return hashed.mapInArrow(run, "doc_id bigint, text string")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(_planted(read(spark, sf_dir, "documents")), min_length=24, min_periods=3)
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    milli = F.expr("1000 * best.length div best.period").alias("exponent_milli")
    return found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period", milli, _sha(listed).alias("runs_sha256"), _sha("collapsed").alias("collapsed_sha256"))


def _sha(text: Column | str) -> Column:
    return F.sha2((F.col(text) if isinstance(text, str) else text).cast("binary"), 256)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}
