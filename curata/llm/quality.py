"""Quality scores by a sparse rule ensemble.

Statistics of each text are computed in one pass. On a bounded labelled sample small boosted trees are grown; every path
from a root to a node is a rule, a conjunction of thresholds. A logistic model with an L1 penalty weighs the rules and
drops most of them. The rules that stay are compiled into one Spark column over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from curata.llm.kernels import Words, blocks, tidy
from curata.llm.scratch import Scratch, held_out

#: Labelled rows that the model is fitted on at most: those with the smallest hashes of their ids.
MAX_TRAIN = 20_000
TREES, DEPTH, BINS, RATE, PENALTY, STEPS = 40, 3, 32, 0.3, 0.002, 400

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "digit": b"0123456789",
    "shout": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@<>{}[]\\/=+~^_`",
    "stop": b".,;:",
    "space": b" \t\r\x0b\x0c",
    "line": b"\n",
}
STATS = [*(f"{c}_share" for c in _CLASSES), "other_share", "log_bytes", "log_words", "word_bytes", "word_spread", "short_words", "long_words", "distinct_words", "distinct_rate", "top_word", "distinct_grams", "line_words", "distinct_lines", "plain_ends"]


def text_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of STATS for each text of a UTF-8 block; an empty text has only zeros and ones that say nothing."""
    n = len(offs) - 1
    size = np.diff(offs)
    some = np.maximum(size, 1)

    def per_text(flags: np.ndarray) -> np.ndarray:
        acc = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=acc[1:])
        return acc[offs[1:]] - acc[offs[:-1]]

    cols = []
    for chars in _CLASSES.values():
        lut = np.zeros(256, bool)
        lut[list(chars)] = True
        cols.append(per_text(lut[data]) / some)
    cols.append(per_text(data >= 128) / some)
    cols.append(np.log1p(size))
    w = Words(data, offs)
    count = np.diff(w.first)
    words = np.maximum(count, 1)
    length = w.end - w.start
    acc = lambda x: (lambda c: c[w.first[1:]] - c[w.first[:-1]])(np.concatenate([[0], np.cumsum(x, dtype=np.float64)]))
    mean = acc(length) / words
    cols += [np.log1p(count), mean, np.sqrt(np.maximum(acc(length.astype(np.float64) ** 2) / words - mean**2, 0)), acc(length <= 3) / words, acc(length >= 14) / words]
    grams, first = w.shingles(3)
    distinct, top, various = np.zeros(n), np.zeros(n), np.ones(n)
    for i in range(n):
        own = np.sort(w.hash[w.first[i] : w.first[i + 1]])
        if len(own):
            at = np.flatnonzero(np.r_[True, own[1:] != own[:-1], True])
            distinct[i], top[i] = len(at) - 1, np.diff(at).max()
            g = np.sort(grams[first[i] : first[i + 1]])
            various[i] = (1 + np.count_nonzero(g[1:] != g[:-1])) / len(g)
    cols += [distinct / words, np.log1p(distinct) / np.log1p(words), top / words, various]
    breaks = np.flatnonzero(data == 10)
    cut = np.union1d(breaks + 1, offs)
    lines = Words(data, cut)
    held = np.searchsorted(offs, cut[:-1], side="right") - 1 if len(cut) > 1 else np.zeros(0, np.int64)
    filled = np.diff(lines.first) > 0 if len(cut) > 1 else np.zeros(0, bool)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(lines.hash, dtype=np.uint64)])
    mark = (sums[lines.first[1:]] - sums[lines.first[:-1]])[filled] if len(cut) > 1 else np.zeros(0, np.uint64)
    owner = held[filled]
    total = np.bincount(owner, minlength=n)
    order = np.lexsort((mark, owner))
    fresh = np.r_[True, (mark[order][1:] != mark[order][:-1]) | (owner[order][1:] != owner[order][:-1])] if len(order) else np.zeros(0, bool)
    cols += [count / np.maximum(total, 1), np.bincount(owner[order][fresh], minlength=n) / np.maximum(total, 1)]
    last = data[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    plain = (last >= 128) | ((last >= 97) & (last <= 122)) | np.isin(last, list(b".,"))
    cols.append(acc(plain) / words)
    return np.stack(cols, axis=1).astype(np.float64)


Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater than, threshold), all of them


@dataclass
class RuleModel:
    rules: list[Rule]
    weights: np.ndarray
    bias: float

    def column(self) -> Column:
        """The score in 0..1 as a column over STATS."""
        total = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            cond = None
            for stat, above, at in rule:
                one = F.col(STATS[stat]) > F.lit(float(at)) if above else F.col(STATS[stat]) <= F.lit(float(at))
                cond = one if cond is None else cond & one
            total = total + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + rule_matrix(self.rules, x) @ self.weights)))


def rule_matrix(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for stat, above, at in rule:
            out[:, k] &= (x[:, stat] > at) if above else (x[:, stat] <= at)
    return out.astype(np.float64)


def _tree(binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Paths of a tree fitted to second-order gradients, and its value for each row."""
    rules: list[Rule] = []
    value = np.zeros(len(grad))

    def grow(rows: np.ndarray, path: Rule, depth: int) -> None:
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, -1, 0)
        if depth < DEPTH and len(rows) >= 20:
            for f in range(binned.shape[1]):
                if len(edges[f]):
                    gs = np.cumsum(np.bincount(binned[rows, f], grad[rows], minlength=len(edges[f]) + 1))[:-1]
                    hs = np.cumsum(np.bincount(binned[rows, f], hess[rows], minlength=len(edges[f]) + 1))[:-1]
                    gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
                    gain[(hs < 0.5) | (h - hs < 0.5)] = 0
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), f, k)
        if best[1] < 0:
            value[rows] = -g / (h + 1)
            return
        _, f, k = best
        low = binned[rows, f] <= k
        for above, own in ((False, rows[low]), (True, rows[~low])):
            deeper = (*path, (f, above, float(edges[f][k])))
            rules.append(deeper)
            grow(own, deeper, depth + 1)

    grow(np.arange(len(grad)), (), 0)
    return rules, value


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Rules from boosted trees, weighted by lasso logistic regression. One class alone gives a constant score."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel([], np.zeros(0), 0.0 if len(y) == 0 else (4.0 if y[0] else -4.0))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[e < x[:, f].max()] for f, e in enumerate(edges)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    rate = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    margin = np.full(len(y), np.log(rate / (1 - rate)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rules, value = _tree(binned, edges, p - y, np.maximum(p * (1 - p), 1e-6))
        found.update(dict.fromkeys(rules))
        margin += RATE * value
    rules = list(found)
    z = rule_matrix(rules, x)
    same: dict[bytes, int] = {}
    for k in range(z.shape[1]):  # rules that hold for the same rows count once
        same.setdefault(z[:, k].astype(bool).tobytes(), k)
    rules, z = [rules[k] for k in same.values()], z[:, list(same.values())]
    # proximal gradient with momentum; the bias is free of the penalty
    step = 4 * len(y) / max(1.0, float(np.linalg.norm(np.c_[z, np.ones(len(y))], 2) ** 2))
    w, b = np.zeros(z.shape[1]), float(np.log(rate / (1 - rate)))
    vw, vb, t = w.copy(), b, 1.0
    for _ in range(STEPS):
        r = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - step * (z.T @ r) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb = vb - step * r.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([rules[k] for k in keep], w[keep], b)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = 0.3, label_id: str | None = None) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and the statistics.

    Labels are read outside the held-out fold only, from at most MAX_TRAIN rows. Null and empty texts have statistics of
    zero and are scored like others; null labels, and labels of ids that are not there, are skipped; without a label all
    scores are 0.5. Of several labels of one id the largest counts; labels have the id in label_id, by default as docs
    have it. Rows of one hash are taken into the sample in the order of their ids and sizes, so ties change nothing. Ids may be null or repeated; other columns are ignored.
    """
    work = Scratch(docs.sparkSession, "quality")

    def run(batches):
        for batch in batches:
            for a, b, data, offs in blocks(batch, "text"):
                x = text_stats(data, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], *[pa.array(x[:, k]) for k in range(x.shape[1])]], ["doc_id", "held_out", *STATS])

    slim = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    stats = work.table(slim.mapInArrow(tidy(run), f"doc_id {kind}, held_out boolean, " + ", ".join(f"{s} double" for s in STATS)), "stats")
    marked = labels.select(F.col(label_id or id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    known = stats.filter(~F.col("held_out")).join(marked, "doc_id").withColumn("at", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)))
    # a cut of the hash range leaves little more than the bound, so what partitions send doesn't grow with their number
    share = 1.2 * MAX_TRAIN / max(1, known.count())
    train = known.filter(F.col("at") < int(min(1.0, share) * (1 << 30))).orderBy("at", "doc_id", "log_bytes").limit(MAX_TRAIN).select("label", *STATS).toPandas()
    model = fit(train[STATS].to_numpy(np.float64), (train["label"].to_numpy() > 0).astype(np.float64))
    return stats.withColumn("score", model.column()).withColumn("predicted", (F.col("score") >= threshold).cast("int")).select("doc_id", "held_out", "score", "predicted", *STATS)
