"""Sampled SentencePiece segmentations by forward filtering and backward sampling.

Pieces never run across the start of a word, so the lattice of a text is a chain of the lattices of its words. The lattices
of the distinct words of a block are built and filtered forward together, one character's depth at a time; then the last
pieces of all words are drawn at once, and the pieces before them, until every word is back at its start. Draws are a
counter-based function of the seed, the row's key, the word's place and the step, so a row's segmentation doesn't depend on
partitions or batches.

Spaces become the meta symbol, and characters without a piece (the meta symbol itself included) are spelt in byte pieces,
so decoding gives the text back byte by byte.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import _power_tables, column, mix, ranges, tidy

META = "▁"
#: Stands for a meta symbol of the text itself while words are cut; a lone surrogate, which no valid text has.
_LITERAL = "\udc00"
#: Words of a text, each with the meta symbols before it; those at its end are a word of their own.
_WORD = re.compile(f"{META}*[^{META}]+|{META}+")
#: Words drawn at a time.
RUN = 300_000
_FILTER_BITS = 21


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Spans:
    """Hashes of all stretches of a text's characters in constant time each."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        up, self.down = _power_tables(n + 1)
        self.acc = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(points.astype(np.uint64)) * up[:n], out=self.acc[1:])

    def hash(self, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
        return mix((self.acc[start + length] - self.acc[start]) * self.down[start] + np.asarray(length).astype(np.uint64))


def distinct_words(points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, number among them of each word): the first of each equal words that start at first, which ends with the length.

    Words with one hash are compared, and told apart one by one should any differ.
    """
    size = np.diff(first)
    hashed = Spans(points).hash(first[:-1], size)
    order = np.argsort(hashed)
    ahead = hashed[order]
    group = np.flatnonzero(np.r_[True, ahead[1:] != ahead[:-1]])
    chosen = np.minimum.reduceat(order, group)
    same = np.empty(len(size), np.int64)
    same[order] = np.repeat(chosen, np.diff(np.r_[group, len(order)]))
    if not (np.array_equal(size[same], size) and np.array_equal(points[ranges(first[same], size)], points)):
        seen: dict[bytes, int] = {}
        same = np.array([seen.setdefault(points[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))], np.int64)
    chosen = np.flatnonzero(same == np.arange(len(same)))
    number = np.empty(len(size), np.int64)
    number[chosen] = np.arange(len(chosen))
    return chosen, number[same]


class PieceModel:
    """Pieces of a SentencePiece model file with log weights. Merge models have ranks, not weights: Zipf's law stands in."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        scores = {i: sp.get_score(i) for i in plain}
        ranked = all(s <= 0 and s == int(s) for s in scores.values())
        self.weights = {}
        self.pieces: list[bytes] = [b""] * len(ids)
        for i in ids:
            self.pieces[i] = sp.id_to_piece(i).replace(META, " ").encode()
        for i in plain:
            piece = sp.id_to_piece(i)
            if re.fullmatch(_WORD, piece):  # one that runs on into the next word has no place in a word's lattice
                self.weights[piece] = (i, -log(2 - scores[i]) if ranked else scores[i])
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in ids if sp.is_byte(i)}
        if len(self.bytes) < 256:
            raise ValueError("the model has no byte pieces, so it can't spell every text")
        for b, i in self.bytes.items():
            self.pieces[i] = bytes([b])
        self.byte_ids = np.array([self.bytes[b] for b in range(256)])
        self.longest = max(map(len, self.weights))
        self.spelt = min(w for _, w in self.weights.values()) - 1.0
        names = list(self.weights)
        size = np.array([len(x) for x in names])
        hashed = Spans(_points("".join(names))).hash(np.cumsum(size) - size, size)
        order = np.argsort(hashed)
        self.hashes = hashed[order]
        self.ids = np.array([self.weights[x][0] for x in names])[order]
        self.logs = np.array([self.weights[x][1] for x in names])[order]
        # the leading bits of a hash say where its run begins; runs are of one piece nearly always
        slot = (self.hashes >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)
        self.run = np.full(1 << _FILTER_BITS, -1, np.int32)
        self.run[slot[::-1]] = np.arange(len(slot), dtype=np.int32)[::-1]
        self.longest_run = int(np.bincount(slot).max())

    def edges(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, last character, piece, log weight) of all pieces in the words that start at first; first ends with the length.

        The piece of a character that is spelt is its byte, or -1 less the character if it has several.
        """
        left = np.repeat(first[1:], np.diff(first)) - np.arange(len(points))
        spans, found, longer = Spans(points), [], np.arange(len(points))
        for length in range(1, self.longest + 1):
            longer = start = longer[left[longer] >= length]
            h = spans.hash(start, length)
            run = self.run[(h >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)]
            some = np.flatnonzero(run >= 0)
            run, h, start = run[some], h[some], start[some]
            hits = []
            for k in range(self.longest_run):
                at = np.minimum(run + k, len(self.hashes) - 1)
                hit = np.flatnonzero(self.hashes[at] == h)
                hits.append((start[hit], at[hit]))
            start, at = (np.concatenate(x) for x in zip(*hits, strict=True))
            found.append((start, start + length - 1, self.ids[at], self.logs[at]))
            if length == 1:
                alone = np.ones(len(points), bool)
                alone[start] = False
                spelt = np.flatnonzero(alone)
                chars = points[spelt].astype(np.int64)
                found.append((spelt, spelt, np.where(chars < 128, self.byte_ids[np.minimum(chars, 127)], -1 - chars), np.full(len(spelt), self.spelt)))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def draw(self, points: np.ndarray, first: np.ndarray, seeds: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
        """(piece, word) of the drawn pieces, in order, of the words that start at first; seeds are one uint64 per word."""
        chosen, occ = distinct_words(points, first)
        size = np.diff(first)[chosen]
        points = points[ranges(first[chosen], size)]
        first = np.concatenate([[0], np.cumsum(size)])
        depth = np.arange(len(points)) - np.repeat(first[:-1], size)
        start, last, piece, logs = self.edges(points, first)
        by_depth = np.argsort(depth.astype(np.uint16) if size.max() < 1 << 16 else depth, kind="stable")
        place = np.empty(len(points), np.int64)
        place[by_depth] = np.arange(len(points))
        order = np.argsort(place[last], kind="stable")
        start, last, piece, logs = start[order], last[order], piece[order], alpha * logs[order]
        heads = np.flatnonzero(np.r_[True, last[1:] != last[:-1]])  # every character ends a piece at least
        node, count, rank = by_depth, np.diff(np.r_[heads, len(last)]), place
        at_start = depth[start] == 0
        cuts = np.searchsorted(depth[node], np.arange(int(size.max()) + 1))
        total, cdf = np.zeros(len(points)), np.zeros(len(last))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            e = slice(heads[a], heads[b] if b < len(heads) else len(last))
            head = heads[a:b] - heads[a]
            mass = np.where(at_start[e], 0.0, total[start[e] - 1]) + logs[e]
            top = np.maximum.reduceat(mass, head)
            mass = np.exp(mass - np.repeat(top, count[a:b]))
            whole = np.add.reduceat(mass, head)
            total[node[a:b]] = top + np.log(whole)
            acc = np.cumsum(mass / np.repeat(whole, count[a:b]))
            before = np.r_[0.0, acc[head[1:] - 1]]
            cdf[e] = np.repeat(np.arange(a, b), count[a:b]) + np.minimum(acc - np.repeat(before, count[a:b]), 1.0)
            cdf[e.start + np.r_[head[1:], e.stop - e.start] - 1] = np.arange(a + 1, b + 1)
        active, at, step = np.arange(len(occ)), first[occ + 1] - 1, 0
        drawn, who = [], []
        while len(active):
            u = (mix(seeds[active] + np.uint64(step * 0xD1B54A32D192ED03 & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            own = rank[at]
            edge, u = heads[own], own + u
            end = edge + count[own] - 1
            on = np.flatnonzero((edge < end) & (cdf[edge] <= u))
            while len(on):  # on to the first of a character's few pieces whose share isn't passed
                edge[on] += 1
                e = edge[on]
                on = on[(e < end[on]) & (cdf[e] <= u[on])]
            drawn.append(piece[edge])
            who.append(active)
            going = ~at_start[edge]
            active, at, step = active[going], start[edge[going]] - 1, step + 1
        steps = np.zeros(len(occ), np.int64)
        for w in who:
            steps[w] += 1
        ends = np.cumsum(steps)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (d, w) in enumerate(zip(drawn, who, strict=True)):  # the k-th draw is the k-th piece from a word's end
            out[ends[w] - 1 - k] = d
        return out, np.repeat(np.arange(len(occ)), steps)

    def sample(self, texts: list[str], keys: np.ndarray, seed: int, alpha: float) -> list[np.ndarray]:
        """Piece ids of each text; keys are one uint64 per text."""
        points = _points(META + META.join(texts)) if texts else np.zeros(0, np.uint32)
        begin = np.array([1 + len(t) for t in texts], np.int64)
        begin = np.cumsum(begin) - begin
        meta = np.uint32(ord(META))
        points = np.where(points == meta, np.uint32(ord(_LITERAL)), np.where(points == 0x20, meta, points))
        points[begin] = meta
        # words as _WORD cuts them: one begins at a text's start and at each meta symbol that follows none
        starts = points == meta
        starts[1:] &= points[:-1] != meta
        starts[begin] = True
        first = np.flatnonzero(starts)
        text_of = np.searchsorted(begin, first, side="right") - 1
        nth = np.arange(len(first)) - np.searchsorted(first, begin)[text_of]
        first = np.r_[first, len(points)]
        row_seed = mix(keys ^ mix(np.array([seed], np.int64).view(np.uint64)))
        seeds = mix(row_seed[text_of] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        ids, owner = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a in range(0, len(text_of), RUN):
            own = first[a : a + RUN + 1]
            drawn, word = self.draw(points[own[0] : own[-1]], own - own[0], seeds[a : a + RUN], alpha)
            ids.append(drawn)
            owner.append(text_of[a + word])
        ids, owner = self._spelt(np.concatenate(ids), np.concatenate(owner))
        cuts = np.searchsorted(owner, np.arange(len(texts) + 1)).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def _spelt(self, ids: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces as int32, and their owners, with characters of several bytes spelt in their byte pieces."""
        where = np.flatnonzero(ids < 0)
        if not len(where):
            return ids.astype(np.int32), owner
        chars, kind = np.unique(-1 - ids[where], return_inverse=True)
        spelt = [chr(c).replace(_LITERAL, META).encode() for c in chars.tolist()]
        size = np.array([len(x) for x in spelt], np.int64)
        count = np.ones(len(ids), np.int64)
        count[where] = size[kind]
        at = (np.cumsum(count) - count)[where]
        out = np.repeat(ids, count).astype(np.int32)
        letters = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        out[ranges(at, size[kind])] = letters[ranges((np.cumsum(size) - size)[kind], size[kind])]
        return out, np.repeat(owner, count)

    def decode(self, ids: np.ndarray) -> str:
        """The text of piece ids; lossless for sampled and for greedy ids of this model alike."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))[1:].decode("utf-8", "replace")


@lru_cache(maxsize=4)
def piece_model(path: str) -> PieceModel:
    """One model for each worker process and file."""
    return PieceModel(path)


def _keys(ids: pa.Array) -> np.ndarray:
    return mix(ids.cast(pa.int64()).fill_null(-1).to_numpy().view(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def _chunks(batch: pa.RecordBatch, limit: int = 2 << 20):
    """Runs of rows with about limit characters at most, or one longer row."""
    texts = column(batch, "text").to_pylist()
    a = 0
    while a < len(texts):
        b, size = a + 1, len(texts[a])
        while b < len(texts) and size + len(texts[b]) <= limit:
            size += len(texts[b])
            b += 1
        yield a, b, texts[a:b]
        a = b


def sample_pieces(docs: DataFrame, model: str, seed: int = 0, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_pieces and ids; with digest ids_crc32, decoded_sha256 and lossless instead of ids.

    alpha is the inverse temperature: large values give the likeliest segmentation. Rows with one id and text have one
    segmentation; a null id draws as an id of its own. Null and empty texts are the lone meta symbol of the first word,
    which decodes to the empty text. The ids are integers; other columns are ignored.
    """

    def run(batches):
        m = piece_model(model)
        for batch in batches:
            keys = _keys(batch.column(0))
            for a, b, texts in _chunks(batch):
                out = m.sample(texts, keys[a:b], seed, alpha)
                size = np.array([len(x) for x in out], np.int64)
                head = [batch.column(0)[a:b], pa.array(size)]
                if digest:
                    back = [m.decode(x) for x in out]
                    cols = [pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in out], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([x == y for x, y in zip(back, texts, strict=True)], pa.bool_())]
                    yield pa.RecordBatch.from_arrays([*head, *cols], ["doc_id", "n_pieces", "ids_crc32", "decoded_sha256", "lossless"])
                else:
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))
                    yield pa.RecordBatch.from_arrays([*head, lists], ["doc_id", "n_pieces", "ids"])

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    kind = "ids_crc32 bigint, decoded_sha256 string, lossless boolean" if digest else "ids array<int>"
    return slim.mapInArrow(tidy(run), f"doc_id bigint, n_pieces bigint, {kind}")


def decode_pieces(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: doc_id and text. A null list is a null text."""

    def run(batches):
        m = piece_model(model)
        for batch in batches:
            texts = [None if x is None else m.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    slim = rows.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(tidy(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, text string")
