"""Exact deduplication by counting quotient filters.

A fingerprint is split into a quotient and a remainder. Each map partition builds filters: slot tables in which the sorted
run of remainders of a quotient lies at its slot or after the runs before it, with bits that say which quotients have a
run and where runs go on, and with counters in slots of their own. Filters of one range from all partitions are read in
the order of their remainders, merge like sorted lists and add their counts, without loss. Remainders with a count above
one name the rows whose whole texts are then compared byte for byte; all others are unique.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import tidy
from curata.llm.scratch import Scratch, free_name

#: Fingerprint bits beyond those that number the rows: about one row in 2**SPARE meets another by chance, which costs a byte
#: comparison and never a wrong result. Rows of a shard: MIN_SHARD up to MAX_SHARDS shards, then more, MAX_SHARD at most.
SPARE, MIN_SHARD, MAX_SHARD, MAX_SHARDS = 14, 1 << 16, 1 << 20, 4096
#: Rows that a task gathers for its filters.
FLUSH = 1 << 20
#: Metadata bits of a slot.
OCCUPIED, CONTINUED, SHIFTED, COUNTER = 1, 2, 4, 8


def normalised(text: Column) -> Column:
    """Null counts as empty; each run of space, tab and line or page breaks becomes one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


class QuotientFilter:
    """A counting quotient filter of fingerprints of so many bits, the upper q_bits of which are the quotient.

    Slot i has metadata meta[i] and a value. OCCUPIED says that quotient i has a run somewhere; CONTINUED that the slot
    goes on with the run of the slot before; SHIFTED that it isn't the slot of its quotient. An entry is its remainder and,
    if it counts more than one, COUNTER slots with the digits of the count less one, lowest first. Runs lie in the order of
    their quotients and entries in the order of their remainders, so the k-th run is that of the k-th occupied quotient.
    """

    def __init__(self, meta: np.ndarray, value: np.ndarray, bits: int, q_bits: int):
        self.meta, self.value, self.bits, self.q_bits = meta, value, bits, q_bits

    @property
    def r_bits(self) -> int:
        return self.bits - self.q_bits

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int) -> QuotientFilter:
        return cls.of(*np.unique(fingerprints.astype(np.uint64), return_counts=True), bits)

    @classmethod
    def of(cls, entries: np.ndarray, counts: np.ndarray, bits: int) -> QuotientFilter:
        """From sorted distinct fingerprints and their counts; about three slots in four are used."""
        q_bits = min(bits - 1, max(1, int(len(entries) * 4 // 3).bit_length()))
        r_bits = bits - q_bits
        digit = np.uint64((1 << r_bits) - 1)
        rest, digits = counts.astype(np.uint64) - np.uint64(1), np.zeros(len(entries), np.int64)
        while (rest > 0).any():
            digits += rest > 0
            rest = rest >> np.uint64(r_bits) if r_bits < 64 else rest * np.uint64(0)
        width = digits + 1
        quotient = (entries >> np.uint64(r_bits)).astype(np.int64)
        before = np.cumsum(width) - width  # slots of the entries before
        at = np.maximum.accumulate(quotient - before) + before if len(entries) else quotient
        # entries of one run lie side by side, which the maximum gives, as their quotients are equal
        slots = max(1 << q_bits, int(at[-1] + width[-1]) if len(at) else 0)
        meta, value = np.zeros(slots, np.uint8), np.zeros(slots, np.uint64)
        value[at] = entries & digit
        meta[quotient] |= OCCUPIED
        meta[at] |= np.where(np.r_[False, quotient[1:] == quotient[:-1]], CONTINUED, 0).astype(np.uint8) if len(at) else np.zeros(0, np.uint8)
        meta[at[at != quotient]] |= SHIFTED
        rest = counts.astype(np.uint64) - np.uint64(1)
        for k in range(int(digits.max(initial=0))):
            own = np.flatnonzero(digits > k)
            slot = at[own] + k + 1
            value[slot] = rest[own] >> np.uint64(k * r_bits) & digit
            meta[slot] |= CONTINUED | SHIFTED | COUNTER
        return cls(meta, value, bits, q_bits)

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The sorted distinct fingerprints and their counts."""
        used = (self.meta & (OCCUPIED | CONTINUED | SHIFTED)) != 0
        entry = np.flatnonzero(used & ((self.meta & COUNTER) == 0))
        head = (self.meta[entry] & CONTINUED) == 0
        quotient = np.flatnonzero(self.meta & OCCUPIED)[np.cumsum(head) - 1]
        counts = np.ones(len(entry), np.int64)
        digit = np.flatnonzero(self.meta & COUNTER)
        owner = np.searchsorted(entry, digit) - 1
        place = digit - entry[owner] - 1
        np.add.at(counts, owner, (self.value[digit] << (place * self.r_bits).astype(np.uint64)).astype(np.int64))
        return (quotient.astype(np.uint64) << np.uint64(self.r_bits)) | self.value[entry], counts

    def merge(self, other: QuotientFilter) -> QuotientFilter:
        """The filter of both inputs' rows: equal fingerprints add their counts, nothing is lost."""
        return self.of(*merged([self.entries(), other.entries()]), self.bits)

    def to_bytes(self) -> bytes:
        width = -(-self.r_bits // 8)
        return bytes([self.q_bits]) + self.meta.tobytes() + np.ascontiguousarray(self.value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, bits: int) -> QuotientFilter:
        q_bits = raw[0]
        width = -(-(bits - q_bits) // 8)
        slots = (len(raw) - 1) // (width + 1)
        wide = np.zeros((slots, 8), np.uint8)
        wide[:, :width] = np.frombuffer(raw, np.uint8, offset=1 + slots).reshape(-1, width)
        return cls(np.frombuffer(raw, np.uint8, slots, 1), wide.view("<u8").ravel(), bits, q_bits)


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted runs of (fingerprints, counts) as one, with the counts of equal fingerprints added."""
    whole, counts = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(whole, kind="stable")  # sorted runs: they are merged, not sorted anew
    whole, counts = whole[order], counts[order]
    first = np.flatnonzero(np.r_[True, whole[1:] != whole[:-1]]) if len(whole) else np.zeros(0, np.int64)
    return whole[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(fps: DataFrame, col: str, bits: int, shard_bits: int) -> DataFrame:
    """Distinct values of the bigint column (of so many bits) that two rows or more have, as the column fp.

    The values go into 2**shard_bits ranges, and each task builds a filter for each range of what it has gathered. A hot
    value is one entry with a count in each of them, so a shard has at most an entry for each filter and distinct value.
    """
    low = bits - shard_bits

    def build(batches):
        pending, size = [], 0

        def flush():
            values = np.sort(np.concatenate(pending).astype(np.uint64))
            shard = (values >> np.uint64(low)).astype(np.int64)
            edges = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True])
            own = values & np.uint64((1 << low) - 1)
            filters = [QuotientFilter.build(own[a:b], low).to_bytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(shard[edges[:-1]].astype(np.int32)), pa.array(filters, pa.binary())], ["shard", "filter"])

        for batch in batches:
            pending.append(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            size += len(pending[-1])
            if size >= FLUSH:  # bounds a worker's memory; a larger partition gives a few filters
                yield flush()
                pending, size = [], 0
        if size:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        queue = [QuotientFilter.from_bytes(raw, low) for raw in table.column("filter").to_pylist()]
        while len(queue) > 1:  # by eights, so that each entry is moved a logarithmic number of times
            queue = [QuotientFilter.of(*merged([f.entries() for f in queue[i : i + 8]]), low) for i in range(0, len(queue), 8)]
        values, counts = queue[0].entries()
        found = (np.uint64(table.column("shard")[0].as_py()) << np.uint64(low)) | values[counts > 1]
        return pa.table({"fp": pa.array(found.view(np.int64), pa.int64())})

    parts = fps.select(F.col(col).cast("bigint").alias("fp")).mapInArrow(tidy(build), "shard int, filter binary")
    return parts.groupBy("shard").applyInArrow(merge, "fp bigint")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty, and empty texts are equal to one another. Of equal texts the smallest id is kept; a null
    id is never smaller than another and keeps its place only where all ids of a group are null. Repeated rows of one id
    are all counted in group_size and all marked kept. An empty table gives an empty result; other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "exact")
    slim = docs.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"))
    digest = F.sha2(F.col("norm").cast("binary"), 256)
    hashed = F.xxhash64("norm")
    rows = work.table(slim.select("doc_id", digest.alias("text_sha256"), hashed.alias("h")), "rows")
    count = rows.count()
    shard_bits = max(0, (count // min(MAX_SHARD, max(MIN_SHARD, count // MAX_SHARDS))).bit_length() - 1)
    bits = min(63, max(24, count.bit_length() + SPARE))
    twice = work.table(repeated_fingerprints(rows.select(F.shiftrightunsigned("h", 64 - bits).alias("fp")), "fp", bits, shard_bits), "twice")
    fp = F.shiftrightunsigned(hashed, 64 - bits)
    # Byte verification: whole texts are the grouping key, pre-aggregated in each partition before anything is shuffled.
    routed = slim.select("doc_id", "norm", fp.alias("fp")).join(twice, "fp", "left_semi")
    verified = routed.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    verified = verified.select(F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"), "keep_id", "group_size")
    joined = rows.drop("h").join(verified, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), keep.eqNullSafe(F.col("doc_id")).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that exact_groups keeps. Repeated rows of one id and text stay or go together."""
    key, sha = free_name(docs, "gone_id"), free_name(docs, "gone_sha")
    gone = exact_groups(docs, id_col, text_col).filter(~F.col("kept")).select(F.col("doc_id").alias(key), F.col("text_sha256").alias(sha)).distinct()
    same = docs[id_col].eqNullSafe(gone[key]) & (F.sha2(normalised(docs[text_col]).cast("binary"), 256) == gone[sha])
    return docs.join(gone, same, "left_anti")
