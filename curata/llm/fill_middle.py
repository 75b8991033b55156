"""Fill-in-the-middle transformation by a streaming matcher in constant memory.

A text is a sequence of units (a run of letters A-Z, a-z, or any other single character). It is read twice: the first pass
counts the units, which turns the document's hashes into two ranks; the second advances a lazy iterator of matches to both
ranks and takes the character offsets at which it stops. No array of units is ever stored, whatever the text's length.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import tidy

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
#: The marks of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Characters of output that a batch gathers; a longer text is a batch of its own.
FLUSH = 1 << 20


def count_units(text: str) -> int:
    """The number of units; only the last one is held."""
    last = deque(enumerate(UNIT.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def offsets(text: str, first: int, second: int) -> tuple[int, int]:
    """The code points after which the first `first` and the first `second` units end; first <= second."""
    units = UNIT.finditer(text)

    def end(steps: int, before: int) -> int:
        return next(islice(units, steps - 1, None)).end() if steps else before

    start = end(first, 0)
    return start, end(second - first, start)


def draws(doc_id: object, seed: int) -> tuple[int, int, int, int]:
    """Four integers of 32 bits from the SHA-256 of `seed:id`; a null id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[8 * k : 8 * k + 8], 16) for k in range(4))


def transform(doc_id: object, text: str, seed: int, plain: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one document."""
    n = count_units(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or h3 % 100 >= 100 - plain or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, PLAIN, None, None, text
    a, b = offsets(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    if h4 % 100 < spm:
        return n, SPM, a, b - a, "".join((SUFFIX, text[b:], PREFIX, text[:a], MIDDLE, text[a:b]))
    return n, PSM, a, b - a, "".join((PREFIX, text[:a], SUFFIX, text[b:], MIDDLE, text[a:b]))


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1, plain: int = 10, spm: int = 20) -> DataFrame:
    """One row per input row: doc_id, n, form, prefix_chars, middle_chars, output.

    plain is the percentage of documents that stay as they are and spm that of the others whose suffix comes first. Empty
    texts and those that hold a mark are plain too; their prefix_chars and middle_chars are null. A null text is empty.
    Rows of one id are cut at the same draws. Ids may be of any type that prints its value; a null id draws like an empty
    one. An empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            rows, size, begin = [], 0, 0
            for i in range(batch.num_rows):
                rows.append(transform(ids[i].as_py(), texts[i].as_py(), seed, plain, spm))
                size += len(rows[-1][-1])
                if size >= FLUSH or i == batch.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([ids[begin : i + 1], *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names)
                    rows, size, begin = [], 0, i + 1

    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of the form was made of. Marks stand once each, since no transformed text holds one."""
    parts = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)
