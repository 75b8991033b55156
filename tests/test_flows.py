"""Files, clusters, requests, actions, sessions and streams end to end on small trees."""

import os
import random
import struct
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from curata.functions import images
from curata.operators import actions, classify, dedup, hamming_index, sessions, similarity, throughput
from curata.operators.components import connected_components
from curata.operators.seen_index import SeenIndex
from curata.plans import pipelines
from curata.plans.scratch import Scratch
from curata.sources import config, connectors, files, sink
from curata.sources import tree as sources_tree
from curata.streaming import requests as queue
from curata.streaming import stateful
from curata.streaming import throughput as streams


def grey(level: int) -> bytes:
    row = b"\0" + bytes(level * (x + 1) % 256 for x in range(8))
    return images.png([(b"IHDR", struct.pack(">IIBBBBB", 8, 8, 8, 0, 0, 0, 0)), (b"IDAT", zlib.compress(row * 8)), (b"IEND", b"")])


@pytest.fixture
def tree(tmp_path):
    for name, data in {"zoo/a.png": grey(3), "ape/b.PNG": grey(3), "zoo/c.png": grey(90), "zoo/d.txt": b"x", "zoo/_hid.png": grey(7), "bad.png": b"not a png"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return tmp_path


def test_scan(spark, tree):
    names = lambda df: sorted(os.path.basename(r.path) for r in df.select("path").collect())
    assert names(files.scan_images(spark, str(tree))) == ["a.png", "b.PNG", "bad.png", "c.png"]
    assert names(files.scan_images(spark, str(tree), hidden=True)) == ["_hid.png", "a.png", "b.PNG", "bad.png", "c.png"]
    assert names(files.scan_images(spark, str(tree / "zoo/a.png"))) == ["a.png"]
    with pytest.raises(FileNotFoundError):
        files.scan_images(spark, str(tree / "none"))


def test_discover_and_apply(spark, tree):
    found = pipelines.discover(spark, str(tree))
    assert found.counts.first().asDict() == {"total": 4, "unique": 3, "duplicates": 1}
    plan = found.actions.collect()
    assert [(r.src, r.dst) for r in plan] == [(f"{tree}/zoo/a.png", f"{tree}/zoo_duplicates/b.PNG_a.png")]
    assert {s for *_, s in actions.apply_actions(found.actions).collect()} == {"planned"} and (tree / "zoo/a.png").exists()
    frozen = spark.createDataFrame(plan, actions.PLAN)
    assert {s for *_, s in actions.apply_actions(frozen, dry_run=False).collect()} == {"done"}
    assert (tree / "zoo_duplicates/b.PNG_a.png").exists() and not (tree / "zoo/a.png").exists()


def test_consolidate(spark, tree):
    rows = {(r.action, r.src): r.dst for r in pipelines.consolidate(spark, str(tree)).collect()}
    copy = f"{tree}/ape_zoo/b.PNG"
    assert rows == {("copy", f"{tree}/ape/b.PNG"): copy, ("delete", f"{tree}/ape/b.PNG"): copy, ("delete", f"{tree}/zoo/a.png"): copy}


@pytest.mark.parametrize("blocked", ["folder is a file", "other bytes there", "plan copies a file onto itself", None])
def test_no_original_goes_without_its_copy(spark, tree, blocked):
    plan = spark.createDataFrame(pipelines.consolidate(spark, str(tree)).collect(), actions.PLAN)
    if blocked == "folder is a file":
        (tree / "ape_zoo").write_bytes(b"in the way")
    elif blocked == "other bytes there":
        (tree / "ape_zoo").mkdir()
        (tree / "ape_zoo/b.PNG").write_bytes(grey(4))
    elif blocked:
        plan = plan.filter("action = 'delete' and src like '%b.PNG'").withColumn("dst", F.col("src"))
    done = actions.apply_actions(plan, dry_run=False).collect()
    left = (tree / "zoo/a.png").exists(), (tree / "ape/b.PNG").exists()
    if blocked:
        assert left == (True, True) and "done" not in {s for *_, s in done}
    else:
        assert left == (False, False) and {s for *_, s in done} == {"done"} and (tree / "ape_zoo/b.PNG").read_bytes() == grey(3)


def test_golden_dedup_and_free_names(spark):
    df = spark.createDataFrame([(f"/d/p{i}", h, 1) for i, h in enumerate("hhkh", 1)] + [("/d/p5", None, 1)], "path string, hash string, size bigint")
    unique, links = dedup.unique_and_duplicates(df)
    assert sorted(r.path for r in unique.collect()) == ["/d/p1", "/d/p3"]
    assert sorted(tuple(r) for r in links.collect()) == [("/d/p1", "/d/p2"), ("/d/p1", "/d/p4")]
    want = spark.createDataFrame([(f"s{i}", "/o/x.png") for i in range(4)] + [("t", "/o/.hid"), ("u", "/o/y")], "src string, dst string")
    held = spark.createDataFrame([("/o/x_1.png",), ("/o/x.png",), ("/o/y",)], "path string")
    assert {r.src: r.dst for r in dedup.free_names(want, held).collect()} == {"s0": "/o/x_2.png", "s1": "/o/x_3.png", "s2": "/o/x_4.png", "s3": "/o/x_5.png", "t": "/o/.hid", "u": "/o/y_1"}


def test_three_scans_give_what_one_gives(spark):
    """In scan order as one table would; a scan added again changes nothing; the index is never shuffled."""
    rng = random.Random(3)
    rows = [(f"/{rng.randrange(10**6):06d}-{k}.png", None if k % 50 == 0 else "hot" if k % 3 == 0 else f"h{rng.randrange(300)}", k % 3 if k < 900 else 2) for k in range(1200)]
    every = spark.createDataFrame(rows, "path string, hash string, scan int")
    index = SeenIndex(spark, "seen_in_test", buckets=4)
    try:
        scans = [every.filter(F.col("scan") == k).select("path", "hash") for k in range(3)]
        got = [r for k in range(3) for r in index.add(scans[k], k).collect()]
        want = {}
        for path, digest, k in sorted(rows, key=lambda r: (r[2], r[0])):
            if digest is not None:
                want.setdefault(digest, (path, k))
        assert len(got) == len(rows) and all((r.first, r.first_scan) == want.get(r.hash, (None, None)) for r in got)
        assert {(r.hash, r.first, r.scan) for r in index.rows().collect()} == {(h, p, k) for h, (p, k) in want.items()}
        size = index.rows().count()
        assert sorted(index.add(scans[2], 2).collect()) == sorted(got[-scans[2].count():]) and index.rows().count() == size
        with pytest.raises(ValueError):
            index.add(scans[1], 1)
        assert index.add(every.limit(0).select("path", "hash"), 3).count() == 0
        index.merge_files()
        assert index.rows().count() == size and sorted(index.marked(scans[2], 2).collect()) == sorted(got[-scans[2].count():])
        spark.sql("ALTER TABLE seen_in_test RENAME TO seen_in_test_merged")  # as a merge that ended midway leaves it
        assert SeenIndex(spark, "seen_in_test", buckets=4).rows().count() == size
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        root = index.looked_up(scans[2], 3)._jdf.queryExecution().executedPlan().initialPlan()
        nodes = [root]
        for node in nodes:
            nodes += [node.children().apply(k) for k in range(node.children().size())]
        assert "seen_in_test" in root.toString() and any("Join" in node.nodeName() for node in nodes)
        exchanges = [node for node in nodes if "Exchange" in node.nodeName()]
        assert exchanges and not any("seen_in_test" in node.toString() for node in exchanges)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        index.drop()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("threshold", [0.05, 0.16])
def test_clusters_against_brute_force(spark, threshold):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(63) for _ in range(20)]
    hashes = [b ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) * rng.randrange(2) for b in base for _ in range(3)] + base
    rows = [(f"/f/{i:03}", h, i) for i, h in enumerate(hashes)] + [("/f/none", None, 1)]
    got = similarity.clusters(spark.createDataFrame(rows, "path string, phash bigint, size bigint"), threshold).collect()
    root = {p: p for p, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    score = {}
    for i, (p, h, _) in enumerate(rows[:-1]):
        for q, g, _ in rows[:i]:
            d = bin(h ^ g).count("1")
            if d / 64 <= threshold:
                score[p, q] = d
                a, b = sorted((find(p), find(q)))
                root[b] = a
    want = {}
    for p, *_ in rows:
        want.setdefault(find(p), []).append(p)
    assert {r.cluster_id: r.paths for r in got} == want
    for r in got:
        own = [d for (p, _), d in score.items() if find(p) == r.cluster_id]
        assert r.avg_score == pytest.approx(sum(own) / 64 / len(own) if own else 0.999)


@pytest.mark.parametrize("threshold", [0.05, 0.16])
def test_similar_pairs_of_repeated_hashes(spark, threshold):
    import random

    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(8)]
    hashes = [b ^ (1 << rng.randrange(63)) * (k % 2) for b in base for k in range(3)] + base
    rows = [(f"/f/{i * 7 % 32:03}", h, i) for i, h in enumerate(hashes)] + [("/f/none", None, 1), ("/f/zero", None, 1)]
    got = similarity.similar_pairs(spark.createDataFrame(rows, "path string, phash bigint, size bigint"), threshold).collect()
    first = {}
    for p, h, _ in sorted(rows[:-2]):
        first.setdefault(h, p)
    want = [(min(p, q), max(p, q), bin(h ^ g).count("1")) for h, p in first.items() for g, q in first.items() if h < g and bin(h ^ g).count("1") / 64 <= threshold]
    copies = [(first[h], p, 0) for p, h, _ in rows[:-2] if first[h] != p]
    assert sorted((r.p1, r.p2, r.bits) for r in got) == sorted(want + copies) and len(copies) >= 8
    assert all(r.score == r.bits / 64 for r in got)


def test_prune_and_rank(spark):
    found = spark.createDataFrame([("a", 0.005, ["a", "b", "c"]), ("d", 0.12, ["d", "e"]), ("f", 0.999, ["f"])], "cluster_id string, avg_score double, paths array<string>")
    sizes = spark.createDataFrame([("a", 30), ("b", 10), ("c", 20)], "path string, size bigint")
    pruned, plan = similarity.prune_full_matches(found, sizes, similarity.ClusterConfig(dry_run=False))
    assert sorted((r.action, r.src) for r in plan.collect()) == [("delete", "a"), ("delete", "c")]
    ranked = similarity.rank_clusters(pruned).orderBy("rank").collect()
    assert [(r.group_id, r.paths, r.avg_score) for r in ranked] == [("00000", ["d", "e"], 0.12), ("00001", ["b"], 0.999), ("00002", ["f"], 0.999)]
    marks = similarity.prune_full_matches(found, sizes, similarity.ClusterConfig())[1]
    assert {r.action for r in marks.collect()} == {"mark"}


def test_cluster_tree(spark, tree):
    ranked, prunes, renames = pipelines.cluster_and_rank(spark, str(tree), similarity.ClusterConfig())
    assert sorted(os.path.basename(r.src) for r in prunes.collect()) == ["a.png"]  # of two copies the smaller path stays
    assert renames.filter("path like '%bad.png'").count() == 1 and similarity.groups_of(renames).count() == ranked.count()


def test_config(spark, tmp_path):
    path = tmp_path / "c.yaml"
    path.write_text(f"workDirectory: {tmp_path}\nclassifications:\n- {{name: Bear, description: b}}\n- {{name: Cat, description: c, priority: 2}}\n- {{name: Duo, description: d, compoundCategory: [Cat, Bear]}}\n")
    base, compound = config.resolve(config.load_config(str(path)).table(spark))
    assert [r.name for r in base.orderBy("pos").collect()] == ["Bear", "Cat"] and compound.first().members == ["Bear", "Cat"]
    assert config.load_config(str(tmp_path / "none")) is None
    for bad in ("{}", f"workDirectory: {tmp_path}", f"workDirectory: {tmp_path}\nclassifications:\n- {{name: x}}", "workDirectory: /none\nclassifications: []"):
        path.write_text(bad)
        with pytest.raises(config.ConfigError):
            config.load_config(str(path))
    rows = spark.createDataFrame([(0, "Duo", ["Gnu"], 0, "d")], config.ROW)
    with pytest.raises(config.ConfigError):
        config.resolve(rows)


def test_category_match(spark):
    base = spark.createDataFrame([("Bear",), ("Cat",), ("Dog",)], "name string")
    compound = spark.createDataFrame([("Duo", ["Cat", "Bear"])], "name string, members array<string>")
    cases = {"1": (["bear"], ["Bear"]), "2": (["bear", "cat"], ["Bear", "Cat", "Duo"]), "3": (["bear", "cat", "dog"], ["Bear", "Cat", "Dog"]), "4": (["bear", "cat", "tree"], ["Bear", "Cat", "Duo"]), "5": (["tree"], ["other"]), "6": ([], ["other"])}
    rows = spark.createDataFrame([(k, t) for k, (t, _) in cases.items()], "image_path string, tags array<string>")
    assert {r.image_path: r.categories for r in classify.match_categories(rows, base, compound).collect()} == {k: w for k, (_, w) in cases.items()}


def test_classify_flow(spark, tmp_path):
    conf = config.Config("/w", "/out", [{"name": n, "compoundCategory": m, "priority": 0, "description": n} for n, m in (("Bear", []), ("Cat", []), ("Duo", ["Bear", "Cat"]))])
    paths = ["/in/bear_cat.png", "/in/late.png", "/in/never.png", "/in/broken.png"]
    unique = spark.createDataFrame([(p,) for p in paths], "path string")
    con = connectors.RuleConnector({"bear": "Bear", "cat": "cat"}, fail={"/in/late.png": 3, "/in/never.png": 9}, broken=("/in/broken.png",))
    results, plan = pipelines.classify_images(spark, conf, unique, con, "s1")
    assert {r.image_path: (r.status, r.attempts) for r in results.collect()} == {paths[0]: ("classified", 1), paths[1]: ("classified", 4), paths[2]: ("exhausted", 4), paths[3]: ("error", 1)}
    dst = sorted(r.dst for r in plan.collect())
    assert [d for d in dst if d.startswith("/out")] == [f"/out/{c}/int_🙂_sticker_bear_cat.png" for c in ("Bear", "Cat", "Duo")] + ["/out/other/int_🙂_sticker_late.png"]
    assert sorted(d for d in dst if not d.startswith("/out")) == ["/in_error/broken.png", "/in_processed/bear_cat.png", "/in_processed/late.png"]
    store = sessions.SessionStore(spark, str(tmp_path / "store"))
    store.create("s1", "/w", "/out", *config.resolve(conf.table(spark)))
    store.set_state("s1", "CLASSIFYING")
    store.add_requests("s1", classify.image_requests(unique, "p", "s1"))
    store.add_results("s1", results)
    assert store.session("s1")["state"] == "CLASSIFYING" and store.summary().first().state == "COMPLETED"
    assert store.categories("s1")[0].count() == 2
    with pytest.raises(KeyError):
        store.session("s2")
    sessions.append_prompt_log(results, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 4


def test_text_requests_and_bad_connector(spark):
    class Breaks:
        def process(self, request):
            raise RuntimeError

    rows = spark.createDataFrame([("s", "text", None, "p", "t", None), ("s", "image", None, "p", "t", None)], classify.REQUEST)
    assert {r.status for r in classify.run_requests(rows, Breaks(), attempts=2).collect()} == {"exhausted"}
    http = connectors.HttpConnector("http://127.0.0.1:9", "m", read_timeout=0.2)
    got = {r.kind: (r.status, r.raw) for r in classify.process(rows.withColumn("attempt", F.lit(0)), http).collect()}
    assert got["text"][0] == "ok" and got["text"][1].startswith("Error: ") and got["image"] == ("retry", None)


def test_trailing_window_excludes_its_edge(spark):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:05:00"), (3, "2024-01-01 00:05:00"), (4, "2024-01-01 00:09:59.999999")]
    df = spark.createDataFrame(rows, "event_id int, t string").select("event_id", F.to_timestamp("t").alias("ts"))
    assert {r.event_id: r.n for r in throughput.trailing_counts(df, 5).collect()} == {1: 1, 2: 2, 3: 2, 4: 3}
    now = F.to_timestamp(F.lit("2024-01-01 00:10:00"))
    gauge = throughput.gauges(df.limit(0), df, F.col("event_id") == 2, now).first()
    assert (gauge.queue, gauge.successes, gauge.errors, gauge.per_minute_5) == (0, 3, 1, 0.2)


def trailing_brute(times, minutes):
    return {t: sum(c for u, c in Counter(times).items() if t - minutes * 60_000_000 < u <= t) for t in times}


def test_trailing_counts_of_a_crowded_hour(spark):
    """Most events in one second, some at one instant, repeated ids, events without a time: as brute force, over many partitions."""
    rng = random.Random(5)
    times = [rng.randrange(10_000_000) for _ in range(3000)] + [7] * 500 + [rng.randrange(8 * 3_600_000_000) for _ in range(1000)]
    rows = spark.createDataFrame([(k % 4000, t) for k, t in enumerate(times)] + [(9999, None)], "event_id int, t long").select("event_id", F.timestamp_micros("t").alias("ts"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = throughput.trailing(rows, [5, 60]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    five, sixty = trailing_brute(times, 5), trailing_brute(times, 60)
    assert sorted((r.event_id, r.micros, r.n5, r.n60) for r in got) == sorted((k % 4000, t, five[t], sixty[t]) for k, t in enumerate(times))
    assert throughput.trailing(rows.limit(0), [5]).count() == 0 and throughput.rates(rows.filter("event_id = 9999")).count() == 0


def test_streamed_trailing_counts_go_on_after_a_restart(spark, tmp_path):
    """Three deliveries, each after a restart: counts come once and exact; an event later than the delay has no effect."""
    rng = random.Random(6)
    hour = 3_600_000_000
    deliveries = [sorted(rng.randrange(k * hour, (k + 2) * hour) // 250_000 * 250_000 for _ in range(400)) for k in (0, 1, 2)]
    late, end = [5], [100 * hour]
    write = lambda k, times: spark.createDataFrame([(t,) for t in times], "t long").select(F.timestamp_micros("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    told = stateful.trailing_stream(stream, [5, 60], delay="90 minutes")
    for k, times in enumerate([*deliveries, late + end]):
        write(k, times)
        stateful.write_batches(told, str(tmp_path / "out"), str(tmp_path / "mark"), interval=None).awaitTermination()
    write(9, late)
    stateful.write_batches(told, str(tmp_path / "out"), str(tmp_path / "mark"), interval=None).awaitTermination()
    got = sorted((r.minutes, r.micros, r.n) for r in stateful.read_batches(told, str(tmp_path / "out")).collect())
    times = [t for d in deliveries for t in d]
    assert got == sorted((m, t, n) for m in (5, 60) for t, n in trailing_brute(times, m).items())
    with pytest.raises(ValueError):
        stateful.trailing_stream(stream, [5], slice_minutes=2)


def test_streaming_queue_with_retries(spark, tmp_path):
    q, out, mark = (str(tmp_path / x) for x in ("q", "out", "mark"))
    rows = spark.createDataFrame([("s", "image", p, "p", "t", None) for p in ("/a_bear.png", "/b_bear.png", "/c_bear.png")], classify.REQUEST)
    con = connectors.RuleConnector({"bear": "bear"}, fail={"/b_bear.png": 2, "/c_bear.png": 9})
    queue.enqueue(rows, q)
    for _ in range(4):
        queue.start_worker(spark, q, out, mark, con).awaitTermination()
    got = {r.image_path: (r.state, r.attempt + 1) for r in queue.finished(spark, out).collect()}
    assert got == {"/a_bear.png": ("classified", 1), "/b_bear.png": ("classified", 3), "/c_bear.png": ("exhausted", 4)}


def test_consumer_chain(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([(1, "ok"), (2, "error"), (3, "odd")], "id int, status string").write.parquet(src)
    took = {}

    def taker(name):
        return lambda batch, _: took.setdefault(name, []).extend(r.id for r in batch.collect())

    def fails(batch, _):
        raise RuntimeError("no")

    chain = streams.Chain([streams.Handler(lambda b: F.lit(True), taker("rest")), streams.Handler(lambda b: F.col("status") == "ok", taker("ok"), 5), streams.Handler(lambda b: F.lit(False), fails, 0)])
    chain.start(streams.read_results(spark, src, "id int, status string"), str(tmp_path / "mark"), None).awaitTermination()
    assert took == {"ok": [1], "rest": [2, 3]} and len(chain.failures) == 1


def test_repair_sink(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x/p.png").write_bytes(b"old")
    rows = spark.createDataFrame([(str(tmp_path / "x/p.png"), bytearray(b"new"))], "path string, fixed binary")
    assert actions.write_repaired(rows).first()[1] == "planned"
    assert actions.write_repaired(rows, dry_run=False).first()[1] == "done"
    assert (tmp_path / "x/p.png").read_bytes() == b"new" and (tmp_path / "broken_imgs/p.png").read_bytes() == b"old"
    assert actions.write_repaired(rows, dry_run=False).first()[1].startswith("failed")


def test_session(spark, tree, tmp_path_factory):
    store = sessions.SessionStore(spark, str(tmp_path_factory.mktemp("store")))
    conf = config.Config(str(tree), "/out", [{"name": "Ape", "compoundCategory": [], "priority": 0, "description": "a"}])
    plan = pipelines.run_session(spark, conf, connectors.RuleConnector({"/ape/": "ape"}), store, "s")
    assert store.session("s")["state"] == "COMPLETED"
    assert plan.filter("action = 'copy' and dst like '/out/Ape/%'").count() == 1
    bad = config.Config("/none/at/all", None, conf.rows)
    with pytest.raises(FileNotFoundError):
        pipelines.run_session(spark, bad, connectors.RuleConnector({}), store, "t")
    assert store.session("t")["state"] == "FAILED"


def test_replayed_batches_queue_nothing_twice(spark, tmp_path):
    q, out, mark = (str(tmp_path / x) for x in ("q", "out", "mark"))
    queue.enqueue(spark.createDataFrame([("s", "image", "/late.png", "p", "t", None)], classify.REQUEST), q)
    con = connectors.RuleConnector({"late": "late"}, fail={"/late.png": 2})
    queue.start_worker(spark, q, out, mark, con).awaitTermination()
    for name in os.listdir(os.path.join(mark, "commits")):  # as after a crash between the work and its commit
        os.remove(os.path.join(mark, "commits", name))
    for _ in range(3):
        queue.start_worker(spark, q, out, mark, con).awaitTermination()
    assert [(r.state, r.attempt) for r in queue.finished(spark, out).collect()] == [("classified", 2)]


def test_session_without_answers_fails(spark, tree, tmp_path_factory):
    store = sessions.SessionStore(spark, str(tmp_path_factory.mktemp("store")))
    conf = config.Config(str(tree), "/out", [{"name": "Ape", "compoundCategory": [], "priority": 0, "description": "a"}])
    silent = connectors.RuleConnector({}, fail={str(p): 9 for p in tree.rglob("*.*")})
    pipelines.run_session(spark, conf, silent, store, "s", settings=config.Settings(workers=3, remove_duplicates=False))
    assert store.session("s")["state"] == "FAILED"


def test_http_connector_keeps_its_line_and_sends_contexts():
    import http.server
    import json
    import threading

    seen = []

    class Answers(http.server.BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            seen.append((self.client_address, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            code = 429 if "busy" in seen[-1][1]["messages"][1]["content"] else 200
            body = json.dumps({"message": {"content": "hi"}}).encode()
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    con = connectors.HttpConnector.of(config.Settings(url=f"http://127.0.0.1:{server.server_port}", text_model="words"))
    assert con.warm_up() == "hi"
    assert con.process({"kind": "text", "prompt": "p", "context": "c", "system_prompt": "s"}) == ("ok", "hi")
    assert con.process({"kind": "image", "prompt": "busy", "content": b"x"}) == ("error", None)
    assert len({a for a, _ in seen}) == 1 and seen[1][1]["messages"][1]["content"] == "Context: c\n\np" and seen[1][1]["model"] == "words"
    server.shutdown()


@pytest.mark.parametrize("bits", [7, 8, 10, 11])
def test_band_neighbours_lose_no_pair(spark, bits):
    import random

    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 14))) for b in base for _ in range(4)]
    rows = [(f"/{k:04d}", v - (1 << 64) if v >> 63 else v) for k, v in enumerate(values)]
    assert hamming_index.bands_for(bits)
    got = {(r.p1, r.p2, r.bits) for r in similarity.similar_pairs(spark.createDataFrame(rows, "path string, phash bigint"), bits / 64).collect()}
    assert got == {(rows[i][0], rows[j][0], d) for i in range(len(rows)) for j in range(i + 1, len(rows)) if (d := (values[i] ^ values[j]).bit_count()) <= bits}


@pytest.mark.parametrize("bits", [10, 15, 19, 26])
@pytest.mark.parametrize("even", [False, True])
def test_index_pairs_are_all_and_candidates_few(spark, monkeypatch, bits, even):
    """Families of hashes, and hashes spread evenly; rings in several parts."""
    import random

    monkeypatch.setattr(hamming_index, "PART", 64)
    rng = random.Random(bits)
    base = [rng.getrandbits(64) for _ in range(400 if even else 40)]
    values = base if even else [b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(30)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    reps = spark.createDataFrame([(v, f"/{k:04d}") for k, v in enumerate(values)] + [(None, "/none")], "phash bigint, p string")
    want = {(f"/{i:04d}", f"/{j:04d}", d) for i, x in enumerate(values) for j, y in enumerate(values[i + 1 :], i + 1) if (d := ((x ^ y) & (1 << 64) - 1).bit_count()) <= bits}
    got = hamming_index.pairs_within(reps, bits).collect()
    assert {(r.p1, r.p2, r.bits) for r in got} == want and len(got) == len(want)
    every = len(values) * (len(values) - 1) // 2
    met = hamming_index.candidates(reps.filter("phash is not null"), bits).count()
    # bands meet a near pair up to four times; rings meet each pair once at most, and of families few beside their own
    most = 4 * len(want) + every // 20 if hamming_index.bands_for(bits) else every if even else 4 * len(want) if bits <= 19 else every
    assert met <= most, (met, len(want), every)
    assert hamming_index.pairs_within(reps.filter("phash is null"), bits).count() == 0


def test_tree_source_lists_what_there_is(spark, tmp_path):
    """Hidden names, names of any case, links, deep and empty folders; dealt out over few and many partitions."""
    for k in range(60):
        path = tmp_path / "/".join(["_h" if k % 5 == 0 else f"d{k % 4}"] + [f"e{j}" for j in range(k % 6)]) / f"{'._'[k % 2]}f{k}.{['png', 'PNG', 'jpg', 'txt'][k % 4]}"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * k)
    (tmp_path / "empty").mkdir()
    (tmp_path / "link").symlink_to(tmp_path / "d1")
    (tmp_path / "gone.png").symlink_to(tmp_path / "nothing")
    want = sorted((os.path.join(d, n), os.path.getsize(os.path.join(d, n))) for d, _, names in os.walk(tmp_path) for n in names if n.lower().endswith((".png", ".jpg")) and os.path.isfile(os.path.join(d, n)))
    for spread in (1, 4, 256):
        got = sources_tree.list_tree(spark, str(tmp_path), ("png", "jpg"), spread)
        assert sorted((r.path, r.size) for r in got.collect()) == want
        assert got.rdd.getNumPartitions() <= spread + 8
    assert len(want) > 40 and got.rdd.getNumPartitions() > 20
    scanned = files.scan_images(spark, str(tmp_path), ("png", "jpg"), hidden=True).collect()
    assert sorted((r.path, len(r.content)) for r in scanned) == want and all(r.modificationTime for r in scanned)


def folder(tmp_path, n):
    for k in range(n):
        (tmp_path / f"in/{k}.png").parent.mkdir(exist_ok=True)
        (tmp_path / f"in/{k}.png").write_bytes(grey(k % 250))
    return [("copy", f"{tmp_path}/in/{k}.png", f"{tmp_path}/out/{k}.png", "r") for k in range(n)]


def held(path):
    return {p.name: p.read_bytes() for p in path.iterdir()} if path.is_dir() else {}


@pytest.mark.parametrize("action", ["copy", "move"])
def test_a_failed_job_is_taken_back(spark, tmp_path, action):
    """A task fails after others have done their work: no original is lost, no copy is left, nothing is deleted."""
    plan = [(action, *r[1:]) for r in folder(tmp_path, 40)] + [("delete", f"{tmp_path}/in/{k}.png", None, "r") for k in range(40)]
    before = held(tmp_path / "in")

    @F.udf("string")
    def breaks(src, kind):
        if src.endswith("/39.png") and kind != "delete":
            import time

            time.sleep(2)  # the other tasks have ended
            raise RuntimeError("lost")
        return src

    frozen = spark.createDataFrame(plan, actions.PLAN).repartition(8, "src")
    real = Scratch.table
    try:  # the plan isn't written, so that it breaks within the job of the actions
        Scratch.table = lambda self, df, name: df.withColumn("src", breaks("src", "action"))
        with pytest.raises(Exception, match="lost"):
            actions.apply_actions(frozen, dry_run=False, journal=str(tmp_path / "journal"))
    finally:
        Scratch.table = real
    assert held(tmp_path / "in") == before and held(tmp_path / "out") == {}
    assert not any(p.read_bytes() for p in (tmp_path / "journal").rglob("*.json*"))  # of the jobs before, without actions
    done = actions.apply_actions(spark.createDataFrame(plan[:40], actions.PLAN), dry_run=False).collect()
    assert {r.status for r in done} == {"done"} and len(done) == 40 and held(tmp_path / "out") == before


def test_a_lost_attempt_is_done_again(tmp_path):
    """What an attempt did before it was killed is found by the next; its journal goes when the job commits."""
    from pyspark.sql import Row

    rows = [Row(action=a, src=s, dst=d) for a, s, d, _ in folder(tmp_path, 6)]
    writer = sink.ActionWriter(str(tmp_path / "journal"))
    writer.write(iter(rows[:3]))  # its message never reaches the driver
    message = writer.write(iter(rows))
    writer.commit([message, None])
    assert held(tmp_path / "out") == held(tmp_path / "in") and [p.suffix for p in (tmp_path / "journal").iterdir()] == [".json"]
    again = sink.ActionWriter(str(tmp_path / "other"))
    moved = again.write(iter([Row(action="move", src=r.src, dst=r.dst + ".moved") for r in rows]))
    assert held(tmp_path / "in") == {} and moved.done == 6
    again.abort([moved, None])
    assert len(held(tmp_path / "in")) == 6 and held(tmp_path / "out") == held(tmp_path / "in") and not list((tmp_path / "other").iterdir())


def test_of_two_sources_of_a_target_the_smaller_wins(spark, tmp_path):
    rows = folder(tmp_path, 4)
    plan = spark.createDataFrame([(a, s, f"{tmp_path}/out/one.png", r) for a, s, _, r in rows][::-1], actions.PLAN).repartition(4)
    assert sorted(tuple(r)[1::2] for r in actions.apply_actions(plan, dry_run=False).collect()) == [(f"{tmp_path}/in/{k}.png", "exists" if k else "done") for k in range(4)]
    assert held(tmp_path / "out") == {"one.png": grey(0)}
    assert actions.apply_actions(plan.limit(0), dry_run=False).collect() == []


def test_keyed_retries_go_on_after_a_restart(spark, tmp_path):
    """Requests that wait for their next attempt when the query is stopped go on from the checkpoint; repeated ones count once."""

    class Slow:
        """A connector that answers the third attempt, and notes its calls in files."""

        def __init__(self, notes):
            self.notes = notes

        def process(self, request):
            import uuid

            (self.notes / f"{request['image_path']}-{request['attempt']}-{uuid.uuid4().hex}").touch()
            answers = {"e": (connectors.ERROR, None), "x": (connectors.OK, "no JSON"), "n": (connectors.OK, '{"detectedTags": [null]}')}
            return answers.get(request["image_path"][0], (connectors.OK, '```json\n{"detectedTags": ["a"]}\n```') if request["attempt"] >= 2 else (connectors.RETRY, None))

    notes = tmp_path / "notes"
    notes.mkdir()
    rows = [(f"{c}{k}", "s", "image", f"{c}{k}", "p") for c in "aexn" for k in range(3)] + [("t", "s", "text", "t", "p"), ("none", "s", "image", None, "p")]
    schema = "request_id string, session_id string, kind string, image_path string, prompt string"
    spark.createDataFrame(rows + rows[:4], schema).write.parquet(str(tmp_path / "in/1"))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    ends = stateful.retried(stream, Slow(notes), backoff_ms=3000)
    begin = lambda: stateful.write_batches(ends, str(tmp_path / "out"), str(tmp_path / "mark"), "update")
    first = stateful.await_rows(begin(), ends, str(tmp_path / "out"), 3)  # the errors; the others wait
    assert first.filter("state != 'error'").count() == 0
    spark.createDataFrame(rows[:5] + [("late", "s", "image", "e9", "p")], schema).write.parquet(str(tmp_path / "in/2"))
    got = stateful.await_rows(begin(), ends, str(tmp_path / "out"), len(rows) + 1, 120).collect()
    want = {r[0]: ("error", 1) if r[0][0] == "e" else ("classified", 3) if r[0][0] == "a" else ("string", 3) if r[0] == "t" else ("exhausted", 4) for r in rows} | {"late": ("error", 1)}
    assert len(got) == len(want) and {r.request_id: (r.state, r.attempts) for r in got} == want
    # stopping may cut a batch short, whose calls are made again; no attempt is left out or added
    for k in range(3):
        assert {p.name.split("-")[1] for p in notes.iterdir() if p.name.startswith(f"a{k}-")} == {"0", "1", "2"}


@pytest.mark.parametrize("raw,good", [('{"detectedTags": ["a"]}', True), ('```json\n{"detectedTags": [1]}\n```', True), ('{"detectedTags": []}', False), ('{"detectedTags": "a"}', False), ('{"detectedTags": ["a", null]}', False), ("[1]", False), ("", False), (None, False), ("x {}", False), ("null", False)])
def test_valid_answers(spark, raw, good):
    assert stateful.valid_answer(raw) == good
    parsed = spark.createDataFrame([(raw,)], "raw string").select(classify.parse_answer(F.col("raw")).alias("a")).first().a
    assert (parsed is not None) == good


def test_completion_waits_and_late_results_have_no_effect(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda minutes: datetime(2024, 1, 1) + timedelta(minutes=minutes)
    asked = [("a", "s", at(0)), ("b", "s", at(1)), ("c", "s", at(2)), ("d", "t", at(3)), ("end", None, at(9000))]
    told = [("a", "classified", at(5)), ("a", "error", at(6)), ("b", "error", at(200)), ("d", "classified", at(3)), ("other", "error", at(4)), ("end", "classified", at(9000))]
    spark.createDataFrame(asked, "request_id string, session_id string, asked_at timestamp").write.parquet(str(tmp_path / "asked"))
    spark.createDataFrame(told, "request_id string, status string, done_at timestamp").coalesce(1).write.parquet(str(tmp_path / "told"))
    both = [spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n)) for n in ("asked", "told")]
    done = stateful.completed(*both)
    stateful.write_batches(done, str(tmp_path / "done"), str(tmp_path / "mark"), interval=None).awaitTermination()
    got = {r.request_id: r.status for r in stateful.read_batches(done, str(tmp_path / "done")).collect()}
    assert set(got) == {"a", "b", "c", "d", "end"} and got["a"] in ("classified", "error") and got["b"] is None and got["c"] is None and got["d"] == "classified"


def test_settings():
    s = config.Settings.of({"curata.workers": "5", "curata.remove_original": "false", "spark.x": "y"})
    assert (s.workers, s.remove_original, s.read_timeout) == (5, False, 60.0)
    with pytest.raises(config.ConfigError):
        config.Settings.of({"curata.nope": "1"})


def test_contents_and_contexts_reach_the_connector(spark, tree):
    class Sends:
        def process(self, request):
            tag = f"{len(request['content'])}-{request['context_size']}"
            return "ok", '{"detectedTags": ["%s"], "hasText": false}' % tag

    found = pipelines.discover(spark, str(tree))
    conf = config.Config(str(tree), "/out", [{"name": "Ape", "compoundCategory": [], "priority": 0, "description": "a"}])
    results, _ = pipelines.classify_images(spark, conf, found.unique, Sends(), "s", images=files.scan_images(spark, str(tree)))
    sizes = {os.path.getsize(r.image_path): r.answer.tags[0] for r in results.collect()}
    assert all(tag == f"{size}-4000" for size, tag in sizes.items())
    results, _ = pipelines.classify_images(spark, conf, found.unique, Sends(), "s", reader=files.usable_bytes)
    assert {os.path.getsize(r.image_path): r.answer.tags[0] for r in results.collect()} == sizes


def binary_exchanges(df):
    """Exchanges of the plan whose output has a binary column."""
    found, open_ = [], [df._jdf.queryExecution().executedPlan()]
    while open_:
        node = open_.pop()
        kinds = [node.output().apply(k).dataType().simpleString() for k in range(node.output().size())]
        if "Exchange" in node.nodeName() and any("binary" in kind for kind in kinds):
            found.append(node.nodeName())
        if node.nodeName() == "AdaptiveSparkPlan":
            open_.append(node.initialPlan())
        open_ += [node.children().apply(k) for k in range(node.children().size())]
    return found


def broken_png(k):
    """A picture of one grey pixel and full alpha in the broken dialect."""
    packed = zlib.compressobj(wbits=-15)
    body = packed.compress(bytes([0, k, k, k, 255])) + packed.flush()
    return images.png([(b"CgBI", bytes(4)), (b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 6, 0, 0, 0)), (b"IDAT", body), (b"IEND", b"")])


def test_contents_stay_where_they_are(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / f"in/b{k}.png").write_bytes(broken_png(k // 2))
    (tmp_path / "in/good.png").write_bytes(grey(2))
    (tmp_path / "in/cut.png").write_bytes(broken_png(9)[:65])
    found = pipelines.discover(spark, str(tmp_path / "in"))
    for df in (found.unique, found.duplicates, found.counts, found.repaired):
        assert binary_exchanges(df) == []
    joined = found.repaired.join(found.repaired.withColumnRenamed("fixed", "f2"), "path")
    assert binary_exchanges(joined) != []  # the test sees one where there is one
    rows = {os.path.basename(r.path): r for r in found.repaired.collect()}
    assert set(rows) == {"b0.png", "b2.png", "b4.png", "cut.png"} and rows["cut.png"].fixed is None and rows["cut.png"].error
    assert [images.decode_png(bytes(rows[f"b{2 * k}.png"].fixed))[0, 0].tolist() for k in range(3)] == [[k, k, k, 255] for k in range(3)]
    checked = pipelines.validate(files.scan_images(spark, str(tmp_path / "in")))
    assert binary_exchanges(checked) == []
    told = {os.path.basename(r.path): (r.fixed, r.error) for r in checked.collect()}
    assert set(told) == {f"b{k}.png" for k in range(6)} | {"cut.png"} and all(told[n] == (r.fixed, r.error) for n, r in rows.items())
    assert files.usable_bytes(f"file://{tmp_path}/in/b2.png") == rows["b2.png"].fixed and files.usable_bytes(str(tmp_path / "none.png")) is None


def test_retries_read_images_anew_by_path(spark, tmp_path):
    """A connector that fails first gets the bytes in every round; a file that is gone is a failed attempt; results hold no bytes."""

    class Fails:
        def process(self, request):
            tag = f"{len(request['content'])}"
            return ("retry", None) if request["attempt"] < 2 else ("ok", '{"detectedTags": ["%s"], "hasText": false}' % tag)

    paths = [tmp_path / f"{k}.png" for k in range(4)]
    for k, path in enumerate(paths[:3]):
        path.write_bytes(b"x" * (k + 1))
    asked = classify.image_requests(spark.createDataFrame([(str(p),) for p in paths], "path string"), "p", "s")
    got = classify.run_requests(asked, Fails(), reader=files.read_bytes)
    assert binary_exchanges(classify.process(asked.repartition(3).withColumn("attempt", F.lit(0)), Fails(), reader=files.read_bytes)) == []
    assert {os.path.basename(r.image_path): (r.status, r.attempts, r.answer and r.answer.tags) for r in got.collect()} == {
        "0.png": ("classified", 3, ["1"]), "1.png": ("classified", 3, ["2"]), "2.png": ("classified", 3, ["3"]), "3.png": ("exhausted", 4, None),
    }
    assert "content" not in got.columns


def test_empty_folders_and_wrong_roots(spark, tmp_path):
    ranked, _, renames = pipelines.cluster_and_rank(spark, str(tmp_path))
    assert renames.count() == 0 and similarity.cluster_summary(ranked).first().clusters == 0
    (tmp_path / "a.png").write_bytes(grey(2))
    with pytest.raises(NotADirectoryError):
        pipelines.consolidate(spark, str(tmp_path / "a.png"))


def test_consumed_tables_go(spark):
    from curata.plans.scratch import consumed

    own = Scratch(spark, "own")
    with consumed():
        inner = Scratch(spark, "inner")
        kept = own.table(inner.table(spark.range(5), "a").filter("id > 1"), "kept")
        assert os.path.isdir(f"{inner.root.removeprefix('file:')}/a")
    assert not os.path.isdir(inner.root.removeprefix("file:")) and kept.count() == 3
    own.drop("kept")
    assert not os.path.isdir(f"{own.root.removeprefix('file:')}/kept")
