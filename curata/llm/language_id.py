"""Language identification by cross-parsing entropy.

For each language a suffix automaton of a bounded labelled sample is built. A text is parsed greedily against each
automaton: a phrase is the longest stretch that occurs in the language's sample. The fewer phrases a text needs (each
weighted by the bits that name a place in the sample, per symbol), the closer it is; the closest language wins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from curata.llm.kernels import blocks, release, tidy
from curata.llm.scratch import free_name, held_out

#: Bounds of the training sample: symbols and documents of a language, and languages (more are an error).
SAMPLE_SYMBOLS, SAMPLE_DOCS, MAX_LANGUAGES = 40_000, 120, 1000
#: Symbols of a lane: texts are parsed in lanes side by side, and phrases are then carried on across lanes. Languages at a time.
LANE, TOGETHER = 512, 8
GAP, OTHER = 0, 1


@dataclass
class Model:
    """languages, their automata in one displaced table, and the bits of a phrase.

    The transition of a state by a symbol is in slot base[state] + symbol, if the slot's owner is the state.
    """

    languages: list[str]
    letters: np.ndarray  # code point -> symbol
    base: np.ndarray
    owner: np.ndarray
    to: np.ndarray
    roots: np.ndarray
    bits: np.ndarray


def letter_classes() -> np.ndarray:
    """For each code point: 0 no letter, 1 letter."""
    out = np.zeros(0x110000, np.int32)
    out[[c for c in range(0x110000) if not 0xD800 <= c < 0xE000 and chr(c).isalpha()]] = OTHER
    return out


def symbols(text_points: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """Symbols of code points; runs without letters are one GAP."""
    s = letters[text_points]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    return s[keep]


def suffix_automaton(seq: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts every substring of seq; state 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in seq:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def displaced(rows: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, owner, to) of an automaton: rows are laid over one another where they don't clash, the fullest first."""
    size = np.array([len(r) for r in rows])
    total = int(size.sum())
    room = total + 4 * width + 4096
    used = bytearray(room)
    base = np.zeros(len(rows), np.int64)
    at = width  # each row is laid at the next place that it fits after the row before, so a place is tried once
    for state in np.argsort(-size, kind="stable").tolist():
        if size[state] < 2:
            break
        syms = sorted(rows[state])
        while any(used[at + c] for c in syms):
            at += 1
            if at + width >= len(used):
                used.extend(bytes(len(used)))
        for c in syms:
            used[at + c] = 1
        base[state] = at
    single = np.flatnonzero(size == 1)
    if len(used) < width + total + len(single) + 1:
        used.extend(bytes(total + len(single) + width))
    free = np.flatnonzero(np.frombuffer(bytes(used), np.uint8)[width:] == 0)[: len(single)] + width
    only = np.array([next(iter(rows[k])) for k in single.tolist()], np.int64)
    base[single] = free - only
    owner, to = np.full(len(used) + width, -1, np.int32), np.zeros(len(used) + width, np.int32)
    state = np.repeat(np.arange(len(rows)), size)
    slot = base[state] + np.array([c for r in rows for c in r], np.int64)
    owner[slot], to[slot] = state, np.array([t for r in rows for t in r.values()], np.int64)
    return base.astype(np.int32), owner, to


def shares(sizes: list[int], total: int) -> int:
    """The most that each of several texts may give so that together they give about total: short ones give all they have."""
    left, share = total, 0
    for k, size in enumerate(sorted(sizes)):
        share = max(1, left // (len(sizes) - k))
        if size > share:
            return share
        left -= size
    return max(sizes, default=0)


def train(samples: dict[str, list[str]]) -> Model:
    """A model of bounded samples. Languages without a letter are left out; texts give equal shares of SAMPLE_SYMBOLS.

    Every letter of the samples is a symbol; the letters beyond them are one that no automaton holds.
    """
    letters = letter_classes()
    seen = {c for texts in samples.values() for c in "".join(texts).lower() if c.isalpha()}
    for k, c in enumerate(sorted(seen)):
        for form in {c, c.upper(), c.title()}:
            if len(form) == 1:
                letters[ord(form)] = k + 2
    width = len(seen) + 2
    names, tables, bits = [], [], []
    for lang in sorted(samples):
        parts = [symbols(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32), letters) for text in samples[lang]]
        share = shares([len(p) + 1 for p in parts], SAMPLE_SYMBOLS)
        seq = [c for p in parts for c in [*p[: share - 1].tolist(), GAP]]
        if not any(x != GAP for x in seq):
            continue
        automaton = suffix_automaton(seq)
        tables.append(displaced([{c: to for c, to in row.items() if c != OTHER} for row in automaton], width))
        names.append(lang)
        bits.append(np.log2(len(seq) + 1))
    state, slot, parts = 0, 0, []
    roots = []
    for base, owner, to in tables:
        roots.append(state)
        parts.append((base + slot, np.where(owner >= 0, owner + state, -1), to + state))
        state, slot = state + len(base), slot + len(owner)
    base, owner, to = (np.concatenate([p[k] for p in parts]).astype(np.int32) if parts else np.zeros(0, np.int32) for k in range(3))
    return Model(names, letters, base, owner, to, np.array(roots, np.int32), np.array(bits))


def _walk(model: Model, seqs: np.ndarray, marks: np.ndarray, shift: np.ndarray, root: np.ndarray, pos: np.ndarray, end: np.ndarray, state: np.ndarray, meet: bool) -> np.ndarray:
    """Parses each lane from pos to end, from a state; marks the starts of its phrases and returns the state at the end.

    The marks of a lane begin at its shift. With meet a lane ends, with -1, at a start that is marked already: from there on
    the phrases are known. Marks that it passes within a phrase are deleted.
    """
    out = np.full(len(pos), -1, np.int32)
    lane = np.arange(len(pos))
    while len(lane):
        sym = seqs[pos]
        at = model.base[state] + sym
        within = (model.owner[at] == state) & (state != root)
        nxt = model.to[at]
        fresh = np.flatnonzero(~within)
        where = shift + pos
        if meet:
            marks[where[within]] = False
            known = marks[where[fresh]]
            marks[where[fresh]] = True
        else:
            marks[where[fresh]] = True
        own = root[fresh]
        at = model.base[own] + sym[fresh]
        nxt[fresh] = np.where(model.owner[at] == own, model.to[at], own)
        pos, state = pos + 1, nxt
        on = pos < end
        if meet:
            on[fresh[known]] = False
        if not on.all():
            ended = ~on
            if meet:
                ended[fresh[known]] = False
            out[lane[ended]] = state[ended]
            lane, pos, end, state, root, shift = lane[on], pos[on], end[on], state[on], root[on], shift[on]
    return out


def running(marks: np.ndarray) -> np.ndarray:
    """How many of the marks come before each place, and all of them at the end."""
    out = np.zeros(len(marks) + 1, np.int32 if len(marks) < 1 << 31 else np.int64)
    np.cumsum(marks, out=out[1:])
    return out


def phrases(model: Model, seqs: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Phrase counts, texts by languages, of the greedy parses of the symbol rows seqs[first[i]:first[i+1]].

    All lanes are parsed from their starts side by side. Then each lane's last phrase is carried on into the next lane
    until a phrase starts where one was marked there; a lane that is crossed whole carries on into the one after it.
    """
    n, k = len(first) - 1, len(model.languages)
    counts = np.zeros((n, k), np.int64)
    size = np.diff(first)
    lanes_of = -(-size // LANE)
    owner = np.repeat(np.arange(n), lanes_of)
    if not len(owner) or not k:
        return counts
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(lanes_of) - lanes_of, lanes_of)
    start = first[owner] + nth * LANE
    stop = np.minimum(start + LANE, first[owner + 1])
    last = np.r_[owner[1:] != owner[:-1], True]
    for c in range(0, k, TOGETHER):
        roots = model.roots[c : c + TOGETHER]
        m, total = len(roots), len(seqs)
        marks = np.zeros(m * total, bool)
        lane, lang = np.tile(np.arange(len(start)), m), np.repeat(np.arange(m), len(start))
        state = _walk(model, seqs, marks, lang * total, roots[lang], start[lane], stop[lane], roots[lang], False)
        while True:
            on = np.flatnonzero((state >= 0) & ~last[lane])
            if not len(on):
                break
            lane, lang, state = lane[on] + 1, lang[on], state[on]
            state = _walk(model, seqs, marks, lang * total, roots[lang], start[lane], stop[lane], state, True)
        for j in range(m):  # a language at a time, as the sums take more memory than the marks
            acc = running(marks[j * total : (j + 1) * total])
            counts[:, c + j] = acc[first[1:]] - acc[first[:-1]]
    return counts


def score_block(model: Model, data: np.ndarray, offs: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """(language, score, bits per symbol, has a letter) for each text of a UTF-8 block."""
    text = data.tobytes().decode("utf-8", "replace")
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    cuts = running((data & 0xC0) != 0x80)[offs]
    s = model.letters[points]
    del text, points
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != GAP) | (s[:-1] != GAP)
    inner = cuts[:-1][cuts[:-1] < len(s)]
    keep[inner] = True
    first = running(keep)[cuts].astype(np.int64)
    seqs = s[keep]
    has_letter = np.diff(running(s != GAP)[cuts]) > 0
    del s, keep
    n = np.maximum(np.diff(first), 1)
    cost = phrases(model, seqs, first) * model.bits / n[:, None]
    if not model.languages:
        return ["und"] * len(n), np.zeros(len(n)), np.zeros(len(n)), has_letter
    best = cost.argmin(axis=1)  # ties: the language first in order
    low = cost[np.arange(len(n)), best]
    rest = cost.copy()
    rest[np.arange(len(n)), best] = np.inf
    second = rest.min(axis=1) if len(model.languages) > 1 else low * 2
    score = np.where(has_letter, second / np.maximum(low + second, 1e-9), 0.0)
    names = [model.languages[b] if h else "und" for b, h in zip(best, has_letter, strict=True)]
    return names, np.clip(np.nan_to_num(score, nan=1.0), 0, 1), np.where(has_letter, low, 0.0), has_letter


def sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """Texts of at most SAMPLE_DOCS documents a language outside the held-out fold, in the order of a hash of their id.

    Repeated rows of one id and text are one document. At most SAMPLE_SYMBOLS characters of a text leave the tasks.
    """
    known = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull() & F.col("l").isNotNull() & ~held_out("i"))
    keyed = known.select("i", "l", F.xxhash64(F.col("i").cast("string")).alias("h"), F.xxhash64("t").alias("th"))
    ranked = keyed.withColumn("r", F.dense_rank().over(W.partitionBy("l").orderBy("h", "i", "th"))).filter(F.col("r") <= SAMPLE_DOCS)
    chosen = ranked.select("i", "l", "h", "th").distinct().limit(MAX_LANGUAGES * SAMPLE_DOCS + 1).toArrow()
    if len(chosen["l"].unique()) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    # an Arrow table, as rows of Python would go through Python workers of another kind, which executors then keep beside the others
    keys = docs.sparkSession.createDataFrame(chosen) if len(chosen) else known.limit(0).select("i", "l", F.lit(0).cast("bigint").alias("h"), F.lit(0).cast("bigint").alias("th"))
    texts = known.withColumn("th", F.xxhash64("t")).select("i", "l", "th", F.substring("t", 1, SAMPLE_SYMBOLS).alias("t")).join(F.broadcast(keys), ["i", "l", "th"]).dropDuplicates(["i", "l", "th"])
    out: dict[str, list[str]] = {}
    for r in texts.select("h", "i", "l", "t").orderBy("h", "i", "t").toLocalIterator():
        out.setdefault(r.l, []).append(r.t)
    return out


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Model | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits (per symbol of the winner).

    lang_pred is `und`, with score 0, for null texts and texts without a letter. Ties go to the first language in
    alphabetical order. Ids and other columns may be null or repeated; where nothing is labelled, all texts are `und`.
    Whole texts are parsed. lang_col is read for the training sample only, outside the held-out fold.
    """
    model = model or train(sample(docs, id_col, text_col, lang_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for batch in batches:
            for a, b, data, offs in blocks(batch, "text"):
                names, score, bits, _ = score_block(m, data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(names, pa.string()), pa.array(score), pa.array(bits)], ["doc_id", "held_out", "lang_pred", "score", "bits"])

    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double, bits double")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", languages: list[str] | None = None) -> DataFrame:
    """The rows of docs, all columns, whose predicted language is one of those given, or any; a null lang becomes the prediction.

    Null texts and texts without a letter have no language and go. Where no row is labelled nothing can be learned: then
    no text is of a given language, and without given ones all texts with a letter stay and lang stays null. Only the
    texts pass through Python, beside their rows, so nothing is joined back or shuffled. The prediction counts as not
    deterministic, or Spark would make it a second time for the filter, by workers of its own in each task.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(sample(docs, id_col, text_col, lang_col)))

    @F.arrow_udf("string")
    def predicted(texts: pa.Array) -> pa.Array:
        out: list[str | None] = []
        for _, _, data, offs in blocks(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            names, _, _, spoken = score_block(model.value, data, offs)
            out += [name if has else None for name, has in zip(names, spoken.tolist(), strict=True)]
        release()
        return pa.array(out, pa.string())

    key = free_name(docs, "predicted")
    found = docs.withColumn(key, predicted.asNondeterministic()(F.col(text_col))).filter(F.col(key).isNotNull())
    if languages is not None:
        found = found.filter(F.col(key).isin(languages))
    label = F.coalesce(F.col(lang_col), F.when(F.col(key) != "und", F.col(key))).cast(docs.schema[lang_col].dataType)
    return found.withColumn(lang_col, label).select(*docs.columns)
