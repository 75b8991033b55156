"""Packing by power-of-two decomposition.

A document of L ids is cut into L // limit pieces of the limit and, for the rest, one piece for each set bit, longest
first. Every piece is a sequence of its own in the bucket of its length, so no sequence crosses documents and none is
padded. The plan has no shuffle: a piece needs nothing but its own document.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache
from itertools import accumulate
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import column, tidy

#: Entries of the memo of pre-token ids; it is emptied when full, so a worker's memory is bounded.
MEMO = 1 << 17

_L = "A-Za-zÀ-ÖØ-öø-ɏ"
_S = "\t\n\x0b\x0c\r "
#: Texts of these characters only are split by _PIECE exactly as the tokenizer's own pattern splits them.
_PLAIN = re.compile(f"[\x00-\x1b\x20-\x7f{_L}]*")
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^{_S}{_L}0-9]+|[{_S}]+(?![^{_S}])|[{_S}]+")


#: What a tokenizer file must say for its texts to be split by _PIECE and merged by ranks.
_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def restated(spec: dict) -> bool:
    """Whether a tokenizer file is of the kind that Encoder restates; of any other kind the library encodes every text."""

    def agrees(have: dict | None, want: dict) -> bool:
        return have is not None and all((have.get(k) or None) == (v or None) for k, v in want.items())

    return spec.get("normalizer") is None and agrees(spec.get("pre_tokenizer"), _SPLIT) and agrees(spec.get("model"), _PLAIN_MODEL)


class Encoder:
    """Ids of a byte-level BPE file of the tokenizers library, as little-endian uint32 bytes.

    Merges never cross the pattern's pre-tokens, so each distinct pre-token is merged once, by the ranks in the same
    file, and a bounded memo gives its ids afterwards. Texts with other characters, or with a special token's string,
    go to the library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.restated = restated(json.loads(Path(path).read_text(encoding="utf-8")))
        merge = merger(path) if self.restated else None
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        outer = self

        class Memo(dict):
            def __missing__(self, piece):
                if len(self) >= MEMO:
                    self.clear()
                self[piece] = out = array("I", merge(piece.encode())).tobytes() if merge else outer.encode(piece)
                return out

        self.memo = Memo()

    def encode(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.restated and _PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.memo.__getitem__, _PIECE.findall(text)))
        return self.encode(text)


def merger(path: str):
    """A function from a pre-token's bytes to its ids, or None if the file's ids don't follow the order of its merges."""
    import tiktoken

    model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
    vocab, pairs = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    # the printable stand-ins of byte-level BPE: bytes that print stand for themselves, the others follow from 256 on
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    stands = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    if ids != sorted(set(ids)) or any(c not in vocab for c in stands) or max(vocab[c] for c in stands) > min(ids, default=1 << 30):
        return None
    ranks = {bytes(stands[c] for c in token): vocab[token] for token in [*stands, *(a + b for a, b in pairs)]}
    return tiktoken.Encoding("merges", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    return Encoder(path)


def decompose(length: int, limit: int) -> list[int]:
    """Piece lengths, powers of two of at most limit (itself a power of two), that sum to length; longest first."""
    rest = length % limit
    return [limit] * (length // limit) + [1 << k for k in range(limit.bit_length() - 2, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket and the ids themselves.

    A null or empty text is its end id alone: one piece of length 1. Repeated rows are packed once each, with sequence
    ids of their own. A null id is carried along. Other columns are ignored; an empty table gives no pieces. bucket is
    log2 of the length: a reader that batches by it never pads.
    """

    def cut(batches):
        enc = encoder(tokenizer)
        tail = np.array([end_id], "<u4").tobytes()
        try:
            for batch in batches:
                yield from pieces_of(enc, tail, batch)
        finally:
            enc.memo.clear()  # an idle worker keeps the encoder only

    def pieces_of(enc, tail, batch):
        ids, texts = batch.column(0), column(batch, "text")
        for a in range(0, len(texts), 64):  # a few documents at a time: the ids of a batch are never held together
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for key, text in zip(ids[a : a + 64].to_pylist(), texts[a : a + 64].to_pylist(), strict=True):
                raw = enc(text) + tail
                total = len(raw) // 4
                sizes = decompose(total, limit)
                for start, size in zip(accumulate(sizes[:-1], initial=0), sizes, strict=True):
                    part = raw[4 * start : 4 * (start + size)]
                    for out, v in zip(rows, (key, start, size, zlib.crc32(part), total, part if with_ids else None), strict=True):
                        out.append(v)
            cols = [pa.array(v, t) for v, t in zip(rows[:5], (ids.type, *[pa.int64()] * 4), strict=True)]
            if with_ids:
                flat = np.frombuffer(b"".join(rows[5]), np.int32)
                offs = np.concatenate([[0], np.cumsum(rows[2])]).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    pieces = slim.mapInArrow(tidy(cut), f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids array<int>" * with_ids)
    bucket: Column = F.log2(F.col("length")).cast("int")
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), bucket.alias("bucket"), *["ids"] * with_ids)
