"""Document fingerprints by homomorphic multiset hashing.

A text is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and the fingerprint is the
sum of the vectors: WIDE lanes of a cryptographic hash (SHAKE128) modulo 2**64 for equality and NEAR lanes modulo 2**32 for likeness, in which a paragraph
counts its word shingles with pseudo-random signs. Sums don't depend on the order, and a paragraph is inserted or deleted
by adding or subtracting its vector. The cosine of the signed NEAR lanes estimates how much two multisets share.
"""

from __future__ import annotations

import base64
import hashlib
from hashlib import shake_128

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import Words, buffers, column, tidy

WIDE, NEAR, GRAM = 32, 256, 3
#: Ranges of ids whose texts are brought together to find each text's successor; a bound on what the driver holds.
MAX_RANGES, RANGE_ROWS = 10_000, 2000


def vectors(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(WIDE lanes uint64, NEAR lanes int32) of each text of a UTF-8 block; empty texts have one empty paragraph."""
    n = len(offs) - 1
    breaks = np.flatnonzero(data == 10)
    # a paragraph ends at each line break and at each text's end
    owner = np.concatenate([np.searchsorted(offs, breaks, side="right") - 1, np.arange(n)])
    end = np.concatenate([breaks, offs[1:]])
    order = np.lexsort((np.r_[np.zeros(len(breaks), int), np.ones(n, int)], end, owner))
    owner, end = owner[order], end[order]
    start = np.where(np.r_[True, owner[1:] != owner[:-1]], offs[owner], np.r_[0, end[:-1] + 1])
    wide, raw = np.zeros((n, WIDE), np.uint64), data.tobytes()
    for a in range(0, len(owner), 4096):
        spans = zip(start[a : a + 4096].tolist(), end[a : a + 4096].tolist(), strict=True)
        lanes = np.frombuffer(b"".join([shake_128(raw[s:e]).digest(8 * WIDE) for s, e in spans]), "<u8").reshape(-1, WIDE)
        text = owner[a : a + 4096]
        firsts = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        wide[text[firsts]] += np.add.reduceat(lanes, firsts, axis=0)
    cut = np.union1d(breaks + 1, offs)
    grams, first = Words(data, cut).shingles(GRAM)
    text_of = np.repeat(np.searchsorted(offs, cut[:-1], side="right") - 1, np.diff(first))
    lane = (grams & np.uint64(NEAR - 1)).astype(np.int64)
    sign = 1.0 - 2.0 * (grams >> np.uint64(63)).astype(np.float64)
    near = np.bincount(text_of * NEAR + lane, sign, minlength=n * NEAR).astype(np.int64).astype(np.int32).reshape(n, NEAR)
    return wide, near


def add(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], sign: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of the united multisets, or for sign -1 those of a without b; sums wrap modulo the powers."""
    with np.errstate(over="ignore"):
        return (a[0] + b[0], a[1] + b[1]) if sign > 0 else (a[0] - b[0], a[1] - b[1])


def encode(wide: np.ndarray, near: np.ndarray) -> list[str]:
    """Fingerprints as base64 of the little-endian lanes."""
    rows = np.concatenate([wide.astype("<u8").view(np.uint8).reshape(len(wide), -1), near.astype("<i4").view(np.uint8).reshape(len(near), -1)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def decode(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    raw = base64.b64decode(fingerprint)
    return np.frombuffer(raw[: 8 * WIDE], "<u8"), np.frombuffer(raw[8 * WIDE :], "<i4")


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """0 to 1 for each row: 1 for equal fingerprints, else the cosine of the NEAR lanes, at least 0."""
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].astype(np.float64), b[1].astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    return np.where(same, 1.0, np.clip((x * y).sum(axis=1) / np.maximum(norm, 1.0), 0.0, 1.0))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id and fingerprint. A null text counts as empty; equal texts have equal fingerprints."""

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(*vectors(*buffers(column(part, "text")))), pa.string())], ["doc_id", "fingerprint"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(tidy(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, fingerprint string")


def edited_text(text: str, after: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many (or all) of the text after it."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def _vectors(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return vectors(*buffers(pa.array(texts, pa.large_string())))


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is the one with the next larger id, after the last the first; a single row follows itself. Repeated
    ids follow one another in the order of their texts; null ids come first. Null texts are empty. The ids are bigint;
    other columns are ignored.

    Ids are cut into ranges by approximate quantiles. Texts are shuffled once, by range; the first text of a range is also
    sent to the range before it, so that no row is looked up later.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ids = slim.select(F.coalesce("doc_id", F.lit(least)).alias("k"))
    rows = ids.count()
    parts = max(1, min(MAX_RANGES, rows // RANGE_ROWS))
    bounds = ids.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 4 * parts)).first()[0] if parts > 1 and rows else []
    edge = np.unique(np.array(bounds, np.int64))

    def ranged(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(edge, batch.column(0).to_numpy(), side="right").astype(np.int32)), batch.column(0)], ["r", "k"])

    heads = ids.mapInArrow(tidy(ranged), "r int, k bigint").groupBy("r").agg(F.min("k").alias("k")).orderBy("r").collect()
    # the range before each range that has rows; the first follows the last
    before = {h.k: heads[i - 1].r for i, h in enumerate(heads)}
    head = np.array(sorted(before), np.int64)
    to = np.array([before[k] for k in head.tolist()], np.int32)

    def deal(batches):
        for batch in batches:
            k = batch.column(0).fill_null(least).to_numpy()
            r = np.searchsorted(edge, k, side="right").astype(np.int32)
            at = np.minimum(np.searchsorted(head, k), len(head) - 1)
            also = np.flatnonzero(head[at] == k)
            yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(np.zeros(len(r), np.int8)), *batch.columns], ["r", "extra", "doc_id", "text"])
            if len(also):
                yield pa.RecordBatch.from_arrays([pa.array(to[at[also]]), pa.array(np.ones(len(also), np.int8)), *[c.take(pa.array(also)) for c in batch.columns]], ["r", "extra", "doc_id", "text"])

    def run(batches):
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        held = None
        for batch in batches:
            extra, key, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for a in range(0, len(key), 256):
                rows = list(zip(extra[a : a + 256], key[a : a + 256], texts[a : a + 256], strict=True))
                chain = [held, *rows] if held else rows
                held = chain[-1]
                pairs = [(x, y) for x, y in zip(chain[:-1], chain[1:], strict=True) if not x[0]]
                if not pairs:
                    continue
                own, after = [x[2] for x, _ in pairs], [y[2] for _, y in pairs]
                edited = [edited_text(x, y) for x, y in zip(own, after, strict=True)]
                mine, others, changed = _vectors(own), _vectors(after), _vectors(edited)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[1] for x, _ in pairs], pa.int64()), pa.array([len(x) for x in own], pa.int64()), pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array(encode(*mine)), pa.array(encode(*changed)), pa.array(likeness(mine, changed)), pa.array(likeness(mine, others))], names
                )

    dealt = slim.mapInArrow(tidy(deal), "r int, extra tinyint, doc_id bigint, text string").repartition("r").sortWithinPartitions("r", "extra", "doc_id", "text")
    return dealt.mapInArrow(tidy(run), "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
