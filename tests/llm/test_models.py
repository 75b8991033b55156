"""Language ID, quality, URL templates and chat links."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from curata.llm import chat, language_id, quality, url_templates
from curata.llm.kernels import Words
from curata.llm.queries import URL_RULES


def test_suffix_automaton_accepts_substrings_only():
    rng = random.Random(0)
    seq = [rng.randrange(2, 5) for _ in range(60)]
    auto = language_id.suffix_automaton(seq)

    def accepts(s):
        state = 0
        for c in s:
            state = auto[state].get(c, -1)
            if state < 0:
                return False
        return True

    subs = {tuple(seq[a:b]) for a in range(60) for b in range(a + 1, min(60, a + 6) + 1)}
    for _ in range(500):
        probe = tuple(rng.randrange(2, 5) for _ in range(rng.randint(1, 5)))
        assert accepts(probe) == (probe in subs)


def test_phrases_against_plain_parsing():
    rng = random.Random(1)
    samples = {"x": ["".join(rng.choice("abcd ") for _ in range(300))], "y": ["".join(rng.choice("cdef ") for _ in range(300))]}
    model = language_id.train(samples)
    texts = ["".join(rng.choice("abcdefz ") for _ in range(n)) for n in (1, 7, 100, 511, 512, 513, 5000)] + ["", "...", samples["x"][0] * 8, "ab" * 2000]

    def plain(text, sample):
        count, at = 0, 0
        while at < len(text):
            k = 0
            while at + k < len(text) and text[at + k] != "\x01" and text[at : at + k + 1] in sample:
                k += 1
            count, at = count + 1, at + max(k, 1)
        return count

    for t in texts:
        pts = np.array([ord(c) for c in t], np.uint32)
        sym = language_id.symbols(pts, model.letters)
        got = language_id.phrases(model, sym, np.array([0, len(sym)]))[0]
        inverse = {int(model.letters[ord(c)]): c for c in "abcdef"} | {0: " ", 1: "\x01"}
        said = "".join(inverse[int(s)] for s in sym)
        for k, lang in enumerate(model.languages):
            seq = language_id.symbols(np.array([ord(c) for c in samples[lang][0]], np.uint32), model.letters)
            sample = "".join(inverse[int(s)] for s in seq) + " "
            assert got[k] == plain(said, sample)


def test_language_accuracy_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert out.count() > 20 and out.filter("lang = lang_pred").count() >= 0.95 * out.count()


def test_language_of_odd_rows(spark, docs_of, odd_rows):
    got = language_id.identify(docs_of(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    said = {r.doc_id: r for r in got}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (3, 4, 5, 10)) and all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in language_id.identify(docs_of([(1, "abc", None)])).collect()} == {"und"}
    assert language_id.identify(docs_of([])).count() == 0
    kept = language_id.keep_identified(docs_of(odd_rows))
    assert kept.schema == docs_of(odd_rows).schema and kept.count() == len(odd_rows) - 5
    assert {r.lang for r in kept.collect()} == {"en", "de", "fr"}  # predicted where it was null
    assert language_id.keep_identified(docs_of([])).count() == 0
    # where nothing is labelled nothing is learned, and texts with a letter stay
    unlabelled = language_id.keep_identified(docs_of([(1, "abc", None), (2, "12", None)])).collect()
    assert [(r.doc_id, r.lang) for r in unlabelled] == [(1, None)]


def test_stage_selects_languages(spark, docs_of):
    rng = random.Random(3)
    word = {"xx": lambda: "".join(rng.choice("abcd") for _ in range(5)), "yy": lambda: "".join(rng.choice("wxyz") for _ in range(5))}
    rows = [(k, " ".join(word[lang]() for _ in range(60)), lang if k < 60 else None) for k in range(100) for lang in [("xx", "yy")[k % 2]]]
    kept = language_id.keep_identified(docs_of(rows), languages=["yy"]).collect()
    assert sorted(r.doc_id for r in kept) == list(range(1, 100, 2)) and {r.lang for r in kept} == {"yy"}
    assert language_id.keep_identified(docs_of(rows)).count() == 100


def test_lanes_don_t_change_the_parse(monkeypatch):
    rng = random.Random(2)
    model = language_id.train({k: ["".join(rng.choice(c) for _ in range(400)) for _ in range(3)] for k, c in {"a": "abc ", "b": "bcd ", "c": "ace "}.items()})
    seqs = [language_id.symbols(np.array([ord(c) for c in t], np.uint32), model.letters) for t in ["".join(rng.choice("abcde ") for _ in range(n)) for n in (0, 3, 900, 2500)] + ["abc" * 700]]
    first = np.cumsum([0, *map(len, seqs)])
    whole = language_id.phrases(model, np.concatenate(seqs), first)
    for lane in (1, 5, 64, 10_000):
        monkeypatch.setattr(language_id, "LANE", lane)
        assert (language_id.phrases(model, np.concatenate(seqs), first) == whole).all()


def test_text_stats():
    texts = ["Hello WORLD! hello", "", "a b\na b\nc", "x" * 5000]
    data = "".join(texts).encode()
    offs = np.cumsum([0, *map(len, texts)])
    got = {s: quality.text_stats(np.frombuffer(data, np.uint8), offs)[:, k] for k, s in enumerate(quality.STATS)}
    assert got["upper_share"][0] == 6 / 18 and got["shout_share"][0] == 1 / 18
    assert got["distinct_words"].tolist() == [2 / 3, 0.0, 3 / 5, 1.0] and got["distinct_lines"][2] == 2 / 3
    assert got["word_bytes"][3] == 5000 and np.isfinite(np.stack(list(got.values()))).all()


def test_words_match_the_pattern():
    import re

    texts = ["A\tb  c", "", "d\x0b e", " f", "g ", "\xa0h i"]
    data = "".join(texts).encode()
    w = Words(np.frombuffer(data, np.uint8), np.cumsum([0, *[len(t.encode()) for t in texts]]))
    got = [[data[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]


def test_rule_ensemble_fits_and_compiles(spark):
    rng = np.random.default_rng(0)
    x = rng.random((800, len(quality.STATS)))
    y = ((x[:, 1] > 0.6) | ((x[:, 3] < 0.3) & (x[:, 5] > 0.5))).astype(float)
    model = quality.fit(x[:600], y[:600])
    assert ((model.score(x[600:]) >= 0.5) == y[600:]).mean() > 0.93 and 0 < len(model.rules) < 300
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[600:650]], quality.STATS)
    assert [r[0] for r in df.select(model.column()).collect()] == pytest.approx(model.score(x[600:650]).tolist())
    assert quality.fit(x[:0], y[:0]).score(x[:2]).tolist() == [0.5, 0.5]


def test_quality_held_out_and_odd_rows(spark, docs_of, odd_rows, sf_dir):
    docs, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = quality.score_quality(docs, labels).join(labels, "doc_id").filter("held_out").select("score", "predicted", "quality").collect()
    assert np.mean([r.predicted == r.quality for r in out]) > 0.9
    good, bad = ([r.score for r in out if r.quality == q] for q in (1, 0))
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.9 and np.mean([r.predicted == 0 for r in out if r.quality == 0]) > 0.6, auc
    named = quality.score_quality(docs.limit(50).withColumnRenamed("doc_id", "id"), labels.withColumnRenamed("doc_id", "of"), id_col="id", label_id="of")
    assert named.count() == 50
    odd = quality.score_quality(docs_of(odd_rows), labels.withColumn("quality", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 2)))
    assert odd.count() == len(odd_rows) and odd.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.score_quality(docs_of([]), labels.limit(0)).count() == 0


def rule_brute(url):
    import re

    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")
    best = None
    for verdict, rule in URL_RULES:
        name, slash, prefix = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith(slash + prefix) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return host, path, best


URLS = [None, "", "nothing", "http://", "HTTP://A.COM", "http://a.com/", "https://Example.com/en/1?x#y", "https://www.example.com/en/1", "http://x.www.example.com/en/", "http://example.com/enx", "http://a.net/es/1", "http://net/fr/", "http://anet/fr/", "http://b.org/p/1", "http://b.org/p/2#http://c.com/", "ftp://h?://x/y", "http://b.org/a/b/c/d/e/f", "http://b.org/\n/x"]


def test_urls(spark):
    pages = spark.createDataFrame([(k, u, "x", 1, "y") for k, u in enumerate(URLS)] + [(None, None, None, None, None), (3, "http://b.org/p/1", "x", 1, "y")], "page_id bigint, url string, host string, n int, template string")
    labels = spark.createDataFrame([(k, False) for k in (13, 14)] + [(None, True), (1, None)], "page_id bigint, good boolean")
    got = url_templates.judge(pages, labels, URL_RULES).collect()
    assert len(got) == len(URLS) + 2
    for r in got:
        if r.page_id is not None and r.page_id != 3:
            host, path, best = rule_brute(URLS[r.page_id])
            assert (r.host, r.path, r.rule) == (host, path, best and best[1]) and (not best or r.verdict == best[0]), r
    assert {r.verdict for r in got} <= {"allow", "block"}
    assert url_templates.judge(pages.limit(0), labels, URL_RULES).count() == 0


def test_templates_learn_from_labels(spark):
    rows = [(k, f"http://h.org/{('good', 'spam')[k % 2]}/{k}") for k in range(400)] + [(1000 + k, f"http://h.org/u{k}/x") for k in range(50)]
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(0, 300)], "page_id bigint, good boolean")
    got = url_templates.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels, []).collect()
    said = {r.page_id: (r.template, r.verdict) for r in got}
    assert said[350] == ("/good/*", "allow") and said[351] == ("/spam/*", "block") and said[1003] == ("/*/*", "allow")


def tree_brute(rows, good):
    """(template, purity) of each (id, host, segments), by plain loops."""
    u, found, level = url_templates, {}, 0
    at = {i: ("", False) for i, _, _ in rows}
    share = {i: float(good[i]) for i, _, _ in rows if good.get(i) is not None}
    while any(not last for _, last in at.values()):
        level += 1
        nodes = {}
        for i, host, segs in rows:
            if not at[i][1]:
                nodes.setdefault((host, at[i][0]), []).append((i, segs))
        for (_, node), members in nodes.items():
            kids = {}
            for i, segs in members:
                if len(segs) < level:
                    at[i] = (node, True)
                else:
                    kids.setdefault(segs[level - 1], []).append((i, len(segs) > level))
            stat = {k: (len(v), sum(i in share for i, _ in v), sum(share.get(i, 0) for i, _ in v)) for k, v in kids.items()}
            own = {k for k, (n, m, _) in stat.items() if n >= u.LEAST and m}
            rare = [stat[k] for k in kids if k not in own]
            parts = [(*stat[k], k) for k in own] + ([(*(sum(x[c] for x in rare) for c in range(3)), None)] if rare else [])
            bins = {}
            for n, m, g, k in parts:
                if m:
                    bins.setdefault(min(int(g / m * u.BINS), u.BINS - 1), []).append((n, m, g, k))
            clusters = []
            for b in sorted(bins):
                m, g = (sum(x[c] for x in bins[b]) for c in (1, 2))
                if clusters:
                    m0, g0 = clusters[-1]["m"], clusters[-1]["g"]
                    pool = (g + g0) / (m + m0)
                if not clusters or abs(g / m - g0 / m0) > u.Z * (max(pool * (1 - pool), 1e-9) * (1 / m + 1 / m0)) ** 0.5:
                    clusters.append({"m": 0, "g": 0.0, "parts": []})
                clusters[-1]["m"] += m
                clusters[-1]["g"] += g
                clusters[-1]["parts"] += bins[b]
            to = {k: ("*", sum(x[0] for x in rare)) for k in kids if k not in own}
            for c, cluster in enumerate(clusters):
                names = [x[3] for x in cluster["parts"]]
                label = "*" if len(clusters) == 1 else names[0] if len(names) == 1 and names[0] is not None else f"*{c}"
                for k in kids if None in names else names:
                    if k in names or k not in own:
                        to[k] = (label, sum(x[0] for x in cluster["parts"]))
            for k, v in kids.items():
                for i, more in v:
                    label, size = to[k]
                    at[i] = (f"{node}/{label}" + ("/**" if more and size < u.LEAST else ""), not more or size < u.LEAST)
    total, hosts, leaves = [0, 0.0], {}, {}
    for i, host, _ in rows:
        for sums in (total, hosts.setdefault(host, [0, 0.0]), leaves.setdefault((host, at[i][0]), [0, 0.0])):
            sums[0] += i in share
            sums[1] += share.get(i, 0)
    base = total[1] / total[0] if total[0] else 1.0
    for i, host, _ in rows:
        m, g = leaves[host, at[i][0]]
        prior = (hosts[host][1] + u.PRIOR * base) / (hosts[host][0] + u.PRIOR)
        found[i] = (at[i][0], (g + u.PRIOR * prior) / (m + u.PRIOR))
    return found


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_templates_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows, good = [], {}
    for i in range(1500):
        host = rng.choice(["a.org", "b.org"])
        segs = [rng.choice(["news", "blog", "shop", "spam", "junk", f"rare{rng.choice('pqrstuvw')}"]) for _ in range(rng.randint(0, 3))] + [rng.choice("xyz")] * rng.choice([0, 1, 4])
        if rng.random() < 0.7:
            bad = 0.8 if "spam" in segs[:2] or "junk" in segs else 0.5 if segs[:1] == ["shop"] else 0.1
            good[i] = rng.random() > bad
        rows.append((i, host, segs))
    pages = spark.createDataFrame([(i, f"http://{h}/{'/'.join(s)}") for i, h, s in rows], "page_id bigint, url string")
    got = {r.page_id: (r.template, r.purity, r.verdict) for r in url_templates.judge(pages, spark.createDataFrame(list(good.items()), "page_id bigint, good boolean"), []).collect()}
    want = tree_brute(rows, good)
    assert {i: t for i, (t, *_) in got.items()} == {i: t for i, (t, _) in want.items()}
    assert all(abs(got[i][1] - p) < 1e-9 and got[i][2] == ("block" if p < url_templates.PURE else "allow") for i, (_, p) in want.items())
    templates = {t for t, _ in want.values()}
    assert any("*0" in t or "*1" in t for t in templates) and any(t.count("/") > 4 for t in templates)


def test_deep_segments_are_told_apart(spark):
    rows = [(k, f"http://h.org/a/b/c/d/e/{('good', 'spam')[k % 2]}/{k}") for k in range(300)]
    labels = spark.createDataFrame([(k, k % 2 == 0) for k in range(200)], "page_id bigint, good boolean")
    said = {r.page_id: r.verdict for r in url_templates.judge(spark.createDataFrame(rows, "page_id bigint, url string"), labels, []).collect()}
    assert said[298] == "allow" and said[299] == "block"


def test_quotes(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow are you?"),
        (1, 1, "a", "On Monday u wrote:\n> Hello there\n> how   are you?\nFine."),
        (1, 2, "u", "> > How are you?\n> Fine.\nGood to hear"),
        (1, 3, "v", ">How are you?\nMe too"),
        (1, 4, "w", "> nobody said this\nhm"),
        (2, 1, "u", "> Hello there\nother conversation"),
        (3, 0, None, None),
        (None, None, "u", "> x"),
        (4, 1, "u", "same"),
        (4, 1, "u", "same"),
        (4, 2, "u", "> same\nyes"),
    ]
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id bigint, turn bigint, role string, text string, said string, level int")
    got = chat.link_quotes(df).collect()
    assert len(got) == len(rows)
    at = {(r.conv_id, r.turn): r for r in got}
    assert at[1, 1].reply == "Fine." and at[1, 1].parent_turn == 0 and at[1, 1].linked_lines == 2
    assert (at[1, 2].parent_turn, at[1, 2].reply_depth, at[1, 2].thread_turn, at[1, 2].quote_depth) == (1, 2, 0, 2)
    assert at[1, 3].parent_turn == 0 and at[1, 3].reply == "Me too"
    assert at[1, 4].parent_turn is None and at[1, 4].thread_turn == 4 and at[2, 1].parent_turn is None
    assert at[4, 2].parent_turn == 1 and at[3, 0].reply == ""
    assert chat.link_quotes(df.limit(0)).count() == 0


def test_nested_quotes(spark):
    rows = [
        (1, 0, "u", "alpha\nbeta\ngamma"),
        (1, 1, "a", "delta"),
        (1, 2, "u", ">> alpha\n> > beta\n>>> delta\nonly deeper levels"),
        (1, 3, "a", "> delta\n>> alpha\n>> beta\n>> gamma\nboth levels"),
        (1, 4, "u", "> nobody said this\n>>> delta\n>> > gamma\n> delta\n"),
        (1, 5, "u", "> nobody said this\n>> nor this"),
        (1, 6, "u", ">>> delta\n>>>> alpha"),
    ]
    at = {r.turn: r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert {t: (r.parent_turn, r.parent_level, r.linked_lines, r.quote_depth, r.thread_turn) for t, r in at.items()} == {
        0: (None, None, 0, 0, 0),
        1: (None, None, 0, 0, 1),
        2: (0, 2, 3, 3, 0),
        3: (1, 1, 4, 2, 1),
        4: (1, 1, 2, 3, 1),
        5: (None, None, 0, 2, 5),
        6: (1, 3, 2, 4, 1),
    }


def quotes_brute(rows):
    """{(conv, turn): (parent, level, linked lines)} by looking through all earlier messages."""
    parsed = {(c, t): chat.passages(text) for c, t, _, text in rows}

    def says(own, lines):
        return any(own[k : k + len(lines)] == lines for k in range(len(own) - len(lines) + 1))

    out = {}
    for (c, t), (quoted, _) in parsed.items():
        def latest(lines, c=c, t=t):
            return max((u for (d, u), (_, own) in parsed.items() if d == c and u < t and says(own, lines)), default=None)

        lowest, lines_of = {}, {}
        for level, lines in quoted:
            lowest[tuple(lines)] = min(level, lowest.get(tuple(lines), level))
            for x in lines:
                lines_of[x] = min(level, lines_of.get(x, level))
        votes, whole = {}, set()
        for lines, level in lowest.items():
            parent = latest(list(lines))
            if parent is not None:
                votes[level, parent] = votes.get((level, parent), 0) + len(lines)
                whole |= set(lines)
        for x, level in lines_of.items():
            parent = latest([x])
            if x not in whole and parent is not None:
                votes[level, parent] = votes.get((level, parent), 0) + 1
        if votes:
            low = min(level for level, _ in votes)
            out[c, t] = (max((n, u) for (level, u), n in votes.items() if level == low)[1], low, sum(votes.values()))
        else:
            out[c, t] = (None, None, 0)
    return out


@pytest.mark.parametrize("block", [1024, 3])
def test_quotes_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(chat, "BLOCK", block)
    rng = random.Random(6)
    lines = [f"line {k}" for k in range(9)]
    rows = []
    for conv in range(6):
        said = []
        for turn in range(14):
            own = rng.sample(lines, rng.randint(1, 4))
            quoted = []
            for _ in range(rng.randint(0, 3)):
                marks = ">" * rng.randint(1, 3)
                if said and rng.random() < 0.6:  # a stretch of an earlier message
                    old = rng.choice(said)
                    a = rng.randrange(len(old))
                    quoted += [f"{marks} {x.upper()} " for x in old[a : a + rng.randint(1, 3)]]
                else:
                    quoted.append(f"{marks} {rng.choice(lines)}")
            said.append(own)
            rows.append((conv, turn, "u", "\n".join(quoted + own)))
    want = quotes_brute(rows)
    got = {(r.conv_id, r.turn): (r.parent_turn, r.parent_level, r.linked_lines) for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == want
    assert {level for _, level, _ in want.values()} == {None, 1, 2, 3}


def test_long_quotes_against_brute_force(spark):
    """Passages of every length up to 13 lines, whole or with one line changed, that open with the same lines."""
    rng = random.Random(11)
    opening = ["dear all", "as said before"]
    rows = [(1, turn, "u", "\n".join(opening + [f"line {rng.randrange(5)}" for _ in range(11)])) for turn in range(4)]
    for turn in range(4, 30):
        old = rows[rng.randrange(4)][3].split("\n")
        a, n = rng.choice([0, 0, rng.randrange(6)]), rng.randint(1, 13)
        lines = old[a : a + n]
        if rng.random() < 0.3:
            lines[rng.randrange(len(lines))] = "line 7"
        rows.append((1, turn, "u", "\n".join("> " + x for x in lines) + f"\nreply {turn}"))
    got = {(r.conv_id, r.turn): (r.parent_turn, r.parent_level, r.linked_lines) for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert got == quotes_brute(rows)


def test_passage_keys_of_stretches(spark):
    lines = [f"l{k % 4}" for k in range(11)]
    own = spark.createDataFrame([(1, 0, lines, "r")], "conv_id bigint, turn bigint, lines array<string>, row string")
    parts = {(a, n): lines[a : a + n] for n in range(1, 12) for a in range(12 - n)}
    wanted = spark.createDataFrame({(1, chat.passage_keys(x)[0], len(x)) for x in parts.values()}, "conv_id bigint, head string, n int")
    got = [r.key for r in chat.said_passages(own, wanted, 4).collect()]
    assert sorted(got) == sorted({chat.passage_keys(x)[1] for x in parts.values()})
    assert len(set(got)) == len({tuple(x) for x in parts.values()})


def test_conversations_are_read_in_the_order_of_replies(spark):
    rng = random.Random(3)
    rows, parent = [], {}
    for conv in range(5):
        for turn in range(0, 80, 2):
            answered = rng.choice([None, *(t for c, t in parent if c == conv)])
            parent[conv, turn] = answered
            quote = "" if answered is None else f"> words of {conv} {answered}\n"
            rows += [(conv, turn, "u", f"{quote}words of {conv} {turn}")] * rng.choice([1, 1, 2])
    rows += [(None, 1, "u", "x"), (1, None, "u", "y"), (9, 5, None, None)]
    linked = chat.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    got = linked.collect()
    assert len(got) == len(rows) and all(r.parent_turn == parent[r.conv_id, r.turn] for r in got if (r.conv_id, r.turn) in parent)

    def above(c, t):
        return [t] if parent.get((c, t)) is None else above(c, parent[c, t]) + [t]

    def place(c, t):
        chain = above(c, t)
        return chain[0], len(chain), chain[-2] if len(chain) > 1 else -1, t

    turns = {(c, t) for c, t, _, _ in rows if c is not None and t is not None}
    want = {(c, t): sorted((place(c, u) for d, u in turns if d == c)).index(place(c, t)) for c, t in turns}
    assert {(r.conv_id, r.turn): r.position for r in got if r.position is not None} == want
    read = chat.reply_ordered(linked).collect()
    assert [(r.conv_id, r.position) for r in read] == sorted((r.conv_id, r.position) for r in read) and len(read) == len(rows) - 2
    assert not any(r.reply.startswith(">") for r in read)


def test_a_passage_outweighs_common_lines(spark):
    para = "first long line\nsecond long line\nthird long line"
    rows = [(1, 0, "a", para), (1, 1, "b", "Thanks\nfirst long line"), (1, 2, "c", "Thanks"), (1, 3, "d", "> " + para.replace("\n", "\n> ") + "\n\n>> Thanks\nI agree")]
    at = {r.turn: r for r in chat.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    assert (at[3].parent_turn, at[3].linked_lines) == (0, 4)  # line by line the first line would be turn 1's
