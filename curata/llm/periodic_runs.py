"""Periodic runs of words by Crochemore's partition refinement.

The positions of a text are kept in classes of equal factors of one length, which grows by a word a round. A round looks at
the positions before those of the small classes only: of the classes that a class has split into, all but the largest. So
a position is looked at a logarithmic number of times in all. Two neighbours of a class whose distance is the length begin
a square of that period, and as nothing lies between them the period is the smallest; squares at adjacent positions merge
into a run. The texts of a block are refined side by side: a class never spans two texts, and an end mark that no other
position has stands after each.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import blocks, ranges, tidy

#: Bytes of text that are refined side by side; a longer text is a block of its own.
BLOCK = 1 << 22
#: Up to this length all positions with a neighbour are looked at in each round; beyond it, those listed for the length.
SCANNED = 24


class Classes:
    """Positions in classes of equal factors, refined length by length.

    The members of class c are order[start[c]:start[c] + size[c]], in any order, and nxt and prv link them in that of
    their positions (-1: none). recent are the members of the small classes of the last round, and changed the positions
    that got another neighbour in it.
    """

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.cls = np.unique(ids, return_inverse=True)[1].astype(np.int64)
        self.count = int(self.cls.max()) + 1 if n else 0
        self.order = np.argsort(self.cls, kind="stable")
        self.loc = np.empty(n, np.int64)
        self.loc[self.order] = np.arange(n)
        self.size, self.start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.size[: self.count] = np.bincount(self.cls, minlength=self.count)
        self.start[: self.count] = np.cumsum(self.size[: self.count]) - self.size[: self.count]
        self.nxt, self.prv = np.full(n, -1), np.full(n, -1)
        self._link(self.order, self.cls[self.order])
        self._moved = np.zeros(n, bool)
        self.recent = self.changed = np.arange(n)

    def _link(self, members: np.ndarray, group: np.ndarray) -> None:
        """Links positions that are sorted by group and place."""
        near = group[1:] == group[:-1]
        self.nxt[members[:-1]] = np.where(near, members[1:], -1)
        self.prv[members[1:]] = np.where(near, members[:-1], -1)
        self.nxt[members[-1:]] = -1
        self.prv[members[:1]] = -1

    def refine(self) -> None:
        """From factors of one length to those that are a word longer."""
        at = self.recent[self.recent > 0] - 1
        at = at[self.size[self.cls[at]] > 1]
        of, by = self.cls[at], self.cls[at + 1]
        order = np.lexsort((at, by, of))
        at, of, by = at[order], of[order], by[order]
        # groups: what one small class takes from a class
        head = np.flatnonzero(np.r_[True, (of[1:] != of[:-1]) | (by[1:] != by[:-1])]) if len(at) else np.zeros(0, np.int64)
        took, owner = np.diff(np.r_[head, len(at)]), of[head]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(head) else head
        groups = np.diff(np.r_[first, len(head)])
        rest = self.size[owner[first]] - (np.add.reduceat(took, first) if len(first) else 0)
        most = np.maximum.reduceat(took, first) if len(first) else took
        # the largest group of each class; where nothing else is left of the class, it stays as the class
        largest = np.zeros(len(head), bool)
        peak = np.flatnonzero(took == np.repeat(most, groups))
        if len(peak):
            largest[peak[np.r_[True, owner[peak][1:] != owner[peak][:-1]]]] = True
        moves = ~(largest & np.repeat(rest == 0, groups))
        if not moves.any():
            self.recent = self.changed = at[:0]
            return
        at = at[np.repeat(moves, took)]
        # a class whose rest is smaller than its largest group hands the rest on instead of that group
        small_rest = (rest > 0) & (rest < most)
        silent = (largest & np.repeat(small_rest, groups))[moves]
        rests = owner[first][small_rest]
        took, owner = took[moves], owner[moves]
        of = np.repeat(owner, took)
        self._unlink(at, of)
        self._move(at, of)
        label = self.count + np.arange(len(took))
        self.count += len(took)
        group = np.repeat(label, took)
        self.cls[at] = group
        self.size[label] = took
        self.start[label] = self.loc[at[np.cumsum(took) - took]]
        self._link(at, group)
        small = [at[np.repeat(~silent, took)]]
        if len(rests):
            small.append(self.order[ranges(self.start[rests], self.size[rests])])
        self.recent = np.concatenate(small)
        self.changed = np.concatenate([self._left, at])

    def _unlink(self, at: np.ndarray, of: np.ndarray) -> None:
        """Takes positions out of their classes' links: chains of neighbours at a time."""
        place = at[np.lexsort((at, of))]
        apart = self.nxt[place[:-1]] != place[1:]
        left, right = self.prv[place[np.r_[True, apart]]], self.nxt[place[np.r_[apart, True]]]
        self.nxt[left[left >= 0]] = right[left >= 0]
        self.prv[right[right >= 0]] = left[right >= 0]
        self._left = left[left >= 0]

    def _move(self, at: np.ndarray, of: np.ndarray) -> None:
        """Brings positions, sorted by class, to the end of their classes' ranges and takes them off; what lay there takes their places."""
        head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        m, c = np.diff(np.r_[head, len(at)]), of[head]
        begin = self.start[c] + self.size[c] - m
        zone = ranges(begin, m)
        self._moved[at] = True
        there = self.order[zone]
        movers = there[~self._moved[there]]
        self._moved[at] = False
        holes = self.loc[at][self.loc[at] < np.repeat(begin, m)]
        self.order[holes] = movers
        self.loc[movers] = holes
        self.order[zone] = at
        self.loc[at] = zone
        self.size[c] -= m


def squares(ids: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(period, sorted positions at which a square of that smallest period begins) for the periods up to the longest."""
    own = Classes(ids)
    nxt = own.nxt
    alive = np.flatnonzero(nxt >= 0)
    listed = defaultdict(list)
    for length in range(1, longest + 1):
        if length > 1:
            own.refine()
        if length <= SCANNED:
            alive = alive[nxt[alive] >= 0]
            near = alive[nxt[alive] - alive == length]
            if not len(alive):
                return
        else:
            if length == SCANNED + 1:  # from here on, positions are listed by the distance of their neighbour
                alive = alive[nxt[alive] >= 0]
                alive = alive[np.argsort(nxt[alive] - alive, kind="stable")]
                apart = nxt[alive] - alive
                alive = alive[np.searchsorted(apart, length) : np.searchsorted(apart, longest, side="right")]
                apart = nxt[alive] - alive
            else:
                for i, d in zip(own.changed.tolist(), (nxt[own.changed] - own.changed).tolist(), strict=True):
                    if length <= d <= longest:
                        listed[d].append(i)
            here = np.concatenate([alive[np.searchsorted(apart, length) : np.searchsorted(apart, length, side="right")], np.array(listed.pop(length, []), np.int64)])
            near = np.unique(here[nxt[here] - here == length])
            if not len(own.recent):
                return  # all classes have one member
        if len(near):
            yield length, near


def find_runs(texts: list[list], min_length: int = 24, min_periods: int = 3) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, smallest period) of each sequence, by start, then period.

    A run is a stretch of min_length elements and min_periods periods or more that can't be extended to either side.
    """
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    ids, first, used = [], [0], 0
    for words in texts:
        seen: dict = {}
        if len(words) >= max(min_length, min_periods):
            ids.append(np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words)) + used)
            ids.append(np.array([used + len(seen)]))  # the end mark
            used += len(seen) + 1
        first.append(first[-1] + (len(words) + 1 if seen else 0))
    longest = max((len(w) for w in texts), default=0) // min_periods
    if not ids or not longest:
        return out
    for period, begin in squares(np.concatenate(ids), longest):
        breaks = np.flatnonzero(np.diff(begin) > 1)
        s, t = begin[np.r_[0, breaks + 1]], begin[np.r_[breaks, len(begin) - 1]]
        long = t - s + 2 * period >= max(min_length, min_periods * period)
        for a, b, k in zip(s[long].tolist(), t[long].tolist(), (np.searchsorted(first, s[long], side="right") - 1).tolist(), strict=True):
            out[k].append((a - first[k], b - a + 2 * period, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words but those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone)[:-1] == 0).tolist()]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest exact length / period; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def repeated_tail(words: list, start: int, period: int) -> list:
    """The words, from start on replaced by the first period of them again and again."""
    tail = len(words) - start
    return words[:start] + (words[start : start + period] * (-(-tail // period)))[:tail]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 24, min_periods: int = 3) -> DataFrame:
    """One row per input row: doc_id, n_words, runs array<struct<start, length, period>>, best (its strongest run), collapsed.

    Words are what white space (space, tab, line and page breaks) separates; they are compared byte for byte, case
    included. A run is a stretch of min_length words and min_periods of its smallest period or more that no neighbouring
    word extends; runs are sorted by start, then period. collapsed has the words but those that a run holds after its
    first period, joined by single spaces. A null, empty or short text has no run, and best is null. Repeated rows and null
    ids are rows like others; an empty table gives an empty result; other columns are ignored. Nothing is shuffled.
    """
    if min_periods < 2:
        raise ValueError("min_periods is at least 2")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    run_kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def as_rows(runs):
        return [None if r is None else {"start": r[0], "length": r[1], "period": r[2]} for r in runs]

    def run(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch, "text", BLOCK):
                raw = data.tobytes()
                texts = [raw[s:e].split() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                runs = find_runs(texts, min_length, min_periods)
                left = [b" ".join(collapsed(w, r)) for w, r in zip(texts, runs, strict=True)]
                cols = [pa.array([len(w) for w in texts], pa.int64()), pa.array([as_rows(r) for r in runs], pa.list_(run_kind)), pa.array(as_rows(map(strongest, runs)), run_kind), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *cols], ["doc_id", "n_words", "runs", "best", "collapsed"])

    kind, of = slim.schema["doc_id"].dataType.simpleString(), "struct<start:bigint,length:bigint,period:bigint>"
    return slim.mapInArrow(tidy(run), f"doc_id {kind}, n_words bigint, runs array<{of}>, best {of}, collapsed string")
