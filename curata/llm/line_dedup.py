"""Line deduplication by range-partitioned hashes.

Every line's key is hashed to 128 bits (BLAKE2b). The rows (hash, document, position) are partitioned by range and sorted
by hash, then document from the largest id down, then position, so a task streams each hash's lines with the document that
keeps them first. The ranges run over documents and positions too, so a line that a third of all rows hold is cut over as
many tasks as its rows need; what a task can't know of the first and the last hash of its range is settled by a summary
of a few documents for each of the two. Results are compressed bitmaps of the lines that stay, without any text.
"""

from __future__ import annotations

import zlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curata.llm.kernels import tidy
from curata.llm.scratch import Scratch, free_name

LEAST = -(1 << 63)
#: Lines that a task sends on at a time.
FLUSH = 1 << 17
#: Kinds of rows of a streamed range: a line that goes, a line that is settled by the summaries, a summary's document.
GONE, OPEN, SUMMARY = 0, 1, 2


def signature(text: Column) -> Column:
    """16 bytes that tell the texts of one id apart."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256), 1, 32))


def line_keys(data: bytes, min_chars: int) -> tuple[int, bytes, np.ndarray]:
    """The number of lines, the hashes of the keys of min_chars code points or more, side by side, and their positions."""
    lines = data.split(b"\n")
    digests, at = [], []
    for i, line in enumerate(lines):
        key = line.strip().lower()  # bytes: the six ASCII spaces, A-Z
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            digests.append(blake2b(key, digest_size=16).digest())
            at.append(i)
    return len(lines), b"".join(digests), np.array(at, np.int32)


def _hashed(min_chars: int):
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                counts, keys, at = zip(*[line_keys(t.as_buffer().to_pybytes(), min_chars) for t in part.column(3)], strict=True)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array([x.tobytes() for x in at], pa.binary())], ["line_row", "doc", "sig", "n_lines", "keys", "at"])

    return run


def _lines(batches):
    """A row (h1, h2, doc, line_row, pos) for each hashed line."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(3)).to_numpy() // 4
        edge = 0
        while edge < len(sizes):
            # as many documents as a batch takes, one at least
            stop = max(edge + 1, edge + int(np.searchsorted(np.cumsum(sizes[edge:]), FLUSH, side="right")))
            n = sizes[edge:stop]
            keys = np.frombuffer(b"".join(x.as_py() for x in batch.column(2)[edge:stop]), ">i8").reshape(-1, 2).astype(np.int64)
            at = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)[edge:stop]), np.int32)
            row, doc = (np.repeat(batch.column(k)[edge:stop].to_numpy(), n) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(doc), pa.array(row), pa.array(at)], ["h1", "h2", "doc", "line_row", "pos"])
            edge = stop


def _streamed(min_docs: int):
    """Sorted rows (h1, h2, doc from the largest down, line_row, pos) of a range to rows (kind, h1, h2, doc, line_row, pos).

    The group of one hash that is open holds its documents, at most min_docs of them, and the lines of those after the
    first until it is known that there are enough; a group that begins a range is sent on open, line by line.
    """

    def rows(kind: int, h1, h2, doc, row, pos) -> pa.RecordBatch:
        n = len(doc)
        cols = [np.full(n, kind, np.int32), np.broadcast_to(h1, n).astype(np.int64), np.broadcast_to(h2, n).astype(np.int64), doc, row, pos]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "h1", "h2", "doc", "line_row", "pos"])

    class Group:
        def __init__(self, key: tuple[int, int], first: bool):
            self.key, self.first, self.docs, self.held = key, first, [], []

        def add(self, doc, row, pos):
            """Takes more of the group's rows; yields what is known of them."""
            for d in doc[np.r_[True, doc[1:] != doc[:-1]]].tolist():
                if len(self.docs) == min_docs:
                    break
                if not self.docs or d != self.docs[-1]:
                    self.docs.append(d)
            if self.first:
                yield rows(OPEN, *self.key, doc, row, pos)
                return
            later = doc != self.docs[0]
            if later.any():
                self.held.append((doc[later], row[later], pos[later]))
            if len(self.docs) == min_docs:
                for held in self.held:
                    yield rows(GONE, *self.key, *held)
                self.held = []

        def close(self, last: bool):
            if self.first or last:
                for held in self.held:
                    yield rows(OPEN, *self.key, *held)
                doc = np.array(self.docs, np.int64)
                yield rows(SUMMARY, *self.key, doc, np.full(len(doc), -1), np.full(len(doc), -1, np.int32))

    def run(batches):
        group = None
        for batch in batches:
            h1, h2, doc, row, pos = (batch.column(k).to_numpy() for k in range(5))
            if not len(h1):
                continue
            edges = np.r_[0, np.flatnonzero((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])) + 1, len(h1)]
            if group is None or group.key != (h1[0], h2[0]):
                if group:
                    yield from group.close(False)
                group = Group((int(h1[0]), int(h2[0])), group is None)
            yield from group.add(doc[: edges[1]], row[: edges[1]], pos[: edges[1]])
            if len(edges) == 2:
                continue
            yield from group.close(False)
            # whole groups in one go: the rank of each line's document within its group, and how many there are
            done, last = edges[1], edges[-2]
            if done < last:
                own = slice(done, last)
                head = np.zeros(last - done, bool)
                head[edges[1:-2] - done] = True
                d = doc[own]
                step = np.cumsum(head | np.r_[True, d[1:] != d[:-1]])
                begin = np.flatnonzero(head)
                rank = step - np.repeat(step[begin], np.diff(np.r_[begin, last - done]))
                many = np.maximum.reduceat(rank, begin) + 1 >= min_docs
                gone = (rank > 0) & np.repeat(many, np.diff(np.r_[begin, last - done]))
                if gone.any():
                    yield rows(GONE, h1[own][gone], h2[own][gone], d[gone], row[own][gone], pos[own][gone])
            group = Group((int(h1[last]), int(h2[last])), False)
            yield from group.add(doc[last:], row[last:], pos[last:])
        if group:
            yield from group.close(True)

    return run


def pack_bits(n_lines: int, dropped: list[int]) -> bytes:
    """A compressed bitmap with a bit for each line, 1 where it stays."""
    bits = np.ones(n_lines, np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits).tobytes())


def unpack_bits(keep: bytes, n_lines: int) -> np.ndarray:
    """The lines that stay, as booleans."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n_lines).astype(bool)


def _bitmaps(batches):
    for batch in batches:
        n, gone = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        keep = [pack_bits(k, g) if g else None for k, g in zip(n, gone, strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([len(g or ()) for g in gone], pa.int64()), pa.array(keep, pa.binary())], ["doc_id", "sig", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per input row: doc_id, sig, n_lines, n_dropped, keep.

    A line's key is the line without white space (space, tab, line and page breaks) at its ends, A-Z folded. Lines whose
    key has min_chars code points or more and is found in min_docs documents or more go, but for those of the document
    with the largest id among them; all its lines of the key stay. keep is a compressed bitmap (unpack_bits), null where
    all lines stay; sig tells the texts of one id apart. Rows of one id count as one document; null ids are one document
    that is smaller than all others. A null or empty text is one empty line. The ids are bigint; an empty table gives an
    empty result; other columns are ignored.
    """
    if min_docs < 2:
        raise ValueError("min_docs is at least 2")
    work = Scratch(docs.sparkSession, "lines")
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(F.monotonically_increasing_id().alias("line_row"), F.col(id_col).cast("bigint").alias("doc"), signature(F.col(text_col)).alias("sig"), text.cast("binary").alias("text"))
    # written, so that the numbers of the rows hold whatever is computed again
    base = work.table(slim.mapInArrow(tidy(_hashed(min_chars)), "line_row bigint, doc bigint, sig binary, n_lines bigint, keys binary, at binary"), "base")
    held = base.filter("length(at) > 0").select("line_row", F.coalesce("doc", F.lit(LEAST)).alias("doc"), "keys", "at")
    order = [F.col("h1"), F.col("h2"), F.col("doc").desc(), F.col("line_row"), F.col("pos")]
    lines = held.mapInArrow(tidy(_lines), "h1 bigint, h2 bigint, doc bigint, line_row bigint, pos int")
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    found = work.table(ranged.mapInArrow(tidy(_streamed(min_docs)), "kind int, h1 bigint, h2 bigint, doc bigint, line_row bigint, pos int"), "found")
    # two hashes for each range at most, whatever the number of lines
    edges = found.filter(F.col("kind") == SUMMARY).groupBy("h1", "h2").agg(F.max("doc").alias("top"), F.count_distinct("doc").alias("n")).filter(F.col("n") >= min_docs)
    settled = found.filter(F.col("kind") == OPEN).join(F.broadcast(edges), ["h1", "h2"]).filter("doc != top")
    gone = found.filter(F.col("kind") == GONE).select("line_row", "pos").unionByName(settled.select("line_row", "pos"))
    each = gone.groupBy("line_row").agg(F.collect_list("pos").alias("gone"))  # one document's lines
    out = base.select("line_row", "doc", "sig", "n_lines").join(each, "line_row", "left").select("doc", "sig", "n_lines", "gone")
    return out.mapInArrow(tidy(_bitmaps), "doc_id bigint, sig binary, n_lines bigint, n_dropped bigint, keep binary")


def drop_lines(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] | None = None) -> DataFrame:
    """The rows of docs, all columns, with the lines that bitmaps (keep_bitmaps of docs) keep, joined by line feeds.

    counts names columns for the number of lines before and of those that went, if they are wanted. Null texts stay null.
    """
    key, sig, n, gone, keep = (free_name(docs, c) for c in ("line_doc", "line_sig", "line_count", "line_gone", "line_keep"))
    some = bitmaps.dropDuplicates(["doc_id", "sig"]).select(F.col("doc_id").alias(key), F.col("sig").alias(sig), F.col("n_lines").alias(n), F.col("n_dropped").alias(gone), F.col("keep").alias(keep))
    names = [*docs.columns, *(counts or ())]
    at, width = docs.columns.index(text_col), len(docs.columns)
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, T.LongType()) for c in counts or ()]])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                lines, bits = part.column(width), part.column(width + 2)
                cols = part.columns[: len(names)]
                if bits.null_count < part.num_rows:
                    texts = cols[at].to_pylist()
                    for i in np.flatnonzero(bits.is_valid().to_numpy(zero_copy_only=False)).tolist():
                        stays = unpack_bits(bits[i].as_py(), lines[i].as_py())
                        texts[i] = "\n".join(line for line, kept in zip(texts[i].split("\n"), stays.tolist(), strict=True) if kept)
                    cols[at] = pa.array(texts, cols[at].type)
                yield pa.RecordBatch.from_arrays(cols, names)

    same = docs[id_col].cast("bigint").eqNullSafe(some[key]) & (signature(docs[text_col]) == some[sig])
    return docs.join(some, same, "left").select(*(docs[c] for c in docs.columns), n, gone, keep).mapInArrow(tidy(run), schema)
