"""Properties and edge cases of the operators on small tables."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import codec, text
from tessera.functions.prefix import running_total
from tessera.operators import access, directory, erasure, graphs, kv, log, placement, sessions, trees, versions
from tessera.streaming import appends

CHANGES = "key string, revision long, op string, cid string, value_kind string"


def history(seed: int, n: int = 300):
    rng = random.Random(seed)
    return [(f"k{rng.randrange(20):02d}", i, rng.choice(["put", "put", "delete"]), f"c{rng.randrange(5)}", "blob") for i in range(1, n + 1)]


def model(rows, upto):
    live = {}
    for key, revision, op, cid, kind in rows:
        if revision <= upto:
            if op == "put":
                live[key] = (cid, kind, live[key][2] + 1 if key in live else 1)
            else:
                live.pop(key, None)
    return live


@pytest.mark.parametrize("upto", [0, 1, 57, 300])
def test_snapshot_is_the_replayed_history(spark, upto):
    rows = history(1)
    random.Random(2).shuffle(rows)  # arrival order doesn't count
    got = {r.key: (r.cid, r.value_kind, r.generation) for r in kv.snapshot(spark.createDataFrame(rows, CHANGES), upto).collect()}
    assert got == model(sorted(rows, key=lambda r: r[1]), upto)


def test_pages_put_together_are_the_scan(spark):
    live = kv.snapshot(spark.createDataFrame(history(3), CHANGES))
    whole, pages, after = [r.key for r in live.orderBy("key").collect()], [], None
    while True:
        page = kv.scan(live, after=after, limit=4).collect()
        pages += [r.key for r in page]
        if not page or not page[0].has_more:
            break
        after = max(r.key for r in page)
    assert pages == whole and len(whole) > 8


def test_keys_compare_bytewise(spark):
    live = spark.createDataFrame([(k, "c") for k in ["a", "Z", "é", "~", ""]], "key string, cid string")
    assert [r.key for r in sorted(kv.scan(live).collect(), key=lambda r: r.key.encode())] == ["", "Z", "a", "~", "é"]
    assert {r.key for r in kv.scan(live, start="a", end="é").collect()} == {"a", "~"}


def test_scan_and_bulk_get_refuse_too_much(spark):
    live = spark.createDataFrame([("a", "c")], "key string, cid string")
    with pytest.raises(ValueError):
        kv.scan(live, limit=10_001)
    with pytest.raises(ValueError):
        kv.get_many(live, ["a"] * 10_001)


def test_diff_applied_gives_the_other_side_and_rollback_restores(spark):
    rows = history(4)
    df = spark.createDataFrame(rows, CHANGES)
    a, b = kv.snapshot(df), kv.snapshot(df, 120)
    undo = versions.rollback(a, b).collect()
    state = {r.key: (r.cid, r.value_kind) for r in a.collect()}
    head = {r.key: r.generation for r in a.collect()}
    for r in undo:
        if r.op == "delete":
            del state[r.key]
        else:
            state[r.key] = (r.cid, r.value_kind)
            assert r.generation == head.get(r.key, 0) + 1
    assert state == {r.key: (r.cid, r.value_kind) for r in b.collect()}
    assert versions.diff(a, a).count() == 0 and versions.logical_diff(b, b).count() == 0


def test_running_total_is_the_window(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None and "c"]) or "c", i * 7, rng.randrange(9)) for i in range(500)]
    got = {(r.k, r.i): r.t for r in running_total(spark.createDataFrame(rows, "k string, i long, v long"), ["k"], ["i"], F.col("v"), "t", width=64).collect()}
    sums: dict = {}
    for k, i, v in rows:
        sums[k] = sums.get(k, 0) + v
        assert got[k, i] == sums[k]


def test_retention_is_the_loop_over_oldest_segments(spark):
    rng = random.Random(6)
    for _ in range(4):
        rows = [(0, i, i * 10, i * 10 + 10, rng.randrange(50), rng.randrange(1000)) for i in range(12)]
        age, most, now = rng.randrange(1000), rng.randrange(300), 1000
        held, want = sum(r[4] for r in rows), []
        for r in rows:
            if r[5] < now - age or held > most:
                want.append(r[1])
                held -= r[4]
        df = spark.createDataFrame(rows, "part long, segment long, base_offset long, end_offset long, payload_bytes long, max_ts long")
        assert sorted(r.segment for r in log.retention_candidates(df, age, most, now).collect()) == want


RECORDS = "part long, batch long, segment long, offset long, key string, value string, ts long, control boolean, producer long, faulty boolean"


def test_compaction_as_a_loop_over_batches(spark):
    rng = random.Random(7)
    faulty = {9}
    rows = [(0, i // 4, i // 32, i, rng.choice([*"abcdef", *"abcdef", None]) if i % 5 == 0 else f"k{i % 7}", rng.choice(["v", None]), rng.randrange(40), i % 31 == 3, 4 if i % 29 == 1 else -1, i // 4 in faulty) for i in range(256)]
    now, grace = 50, 15
    latest, batches = {}, {}
    for r in rows:
        batches.setdefault(r[1], []).append(r)
        if r[4] is not None and r[1] not in faulty:
            latest[r[4]] = r[1]
    want = set()
    for b, rs in batches.items():
        keyed = [r for r in rs if r[4] is not None and b not in faulty]
        always = b in faulty or any(r[7] or r[8] >= 0 or r[4] is None for r in rs)
        if always or any(r[5] is None and now - r[6] < grace for r in keyed) or any(latest[r[4]] == b for r in keyed) or b % 8 in (0, 7):
            want.add(b)
    got = log.compact(spark.createDataFrame(rows, RECORDS), now, grace, spark.createDataFrame([(0, 8)], "part long, end_segment long"))
    assert {r.batch for r in got.filter("kept").collect()} == want and len(want) < 64


def test_fetch_returns_one_batch_at_least(spark):
    rows = [(0, b, b * 10, b * 10 + 9, 10, 100, 0) for b in range(6)]
    df = spark.createDataFrame(rows, "part long, batch long, base_offset long, last_offset long, records long, bytes long, max_ts long")
    assert [r.batch for r in log.fetch(df, 25, 1).collect()] == [2]
    assert sorted(r.batch for r in log.fetch(df, 25, 250).collect()) == [2, 3]
    assert log.fetch(df, 60, 250).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 6), st.integers(1, 3)), max_size=30))
def test_producer_never_accepts_gaps(batches):
    p, log_ = sessions.Producer(), []
    for epoch, base, count in batches:
        if sessions.append_step(p, epoch, base, count) == "append":
            log_.append((epoch, base, count))
    for (e1, b1, c1), (e2, b2, _) in zip(log_, log_[1:]):
        assert (e1 == e2 and b2 == b1 + c1) or (e2 > e1 and b2 == 0)


def replayed(commands, timeout):
    state, parts, deadline, out = "empty", set(), 0, []
    for seq, op, part, at in commands:
        gone, shown = [], None
        if op == "begin":
            state, parts, deadline = "ongoing", set(), at + timeout
        elif op == "append" and state == "ongoing":
            parts.add(part)
            deadline = at + timeout
        elif state == "ongoing" and (op in ("commit", "abort") or op == "expire" and deadline <= at):
            state = "committed" if op == "commit" else "aborted"
            gone = sorted(parts) if state == "aborted" else []
        elif op in ("commit", "abort") and state != ("committed" if op == "commit" else "aborted"):
            shown = "error"
        out.append((seq, shown or state, gone))
    return out


def test_transactions_as_a_replay(spark):
    rng = random.Random(3)
    rows, want = [], []
    for producer in range(4):
        at, mine = 0, []
        for seq in range(300):
            at += rng.randrange(4)
            mine.append((seq, rng.choice(["begin", "append", "append", "append", "commit", "abort", "expire"]), rng.randrange(3), at))
        rows += [(producer, seq, op, part, seq, at) for seq, op, part, at in mine]
        want += [(producer, *x) for x in replayed(mine, 5)]
    df = spark.createDataFrame(rows, "producer long, seq long, op string, part long, offset long, at long")
    got = [(r.producer, r.seq, r.status, list(r.aborted)) for r in sessions.fold_transactions(df, 5).collect()]
    assert sorted(got) == want


def test_groups_have_the_least_member_as_leader():
    g, step = sessions.Group(), sessions.group_step
    assert step(g, "join", "b", 0, 0, 9) == "ok" and step(g, "join", "a", 0, 1, 9) == "ok"
    assert step(g, "sync", "b", 2, 2, 9) == "fenced" and step(g, "sync", "a", 2, 2, 9) == "ok"
    assert step(g, "heartbeat", "b", 2, 9, 9) == "ok" and step(g, "heartbeat", "a", 2, 12, 9) == "unknown"


def test_a_large_group_costs_no_pass_over_its_members_a_command():
    import time

    def plain(members, generation, op, member, asked, at):  # the SQL's step
        for m in [m for m, seen in members.items() if at - seen > 20]:
            del members[m]
            generation += 1
        if op == "join":
            members[member] = at
            return "ok", generation + 1
        if member not in members:
            return "unknown", generation
        if op == "leave":
            del members[member]
            return "ok", generation + 1
        if asked != generation or (op == "sync" and member != min(members)):
            return "fenced", generation
        members[member] = at
        return "ok", generation

    rng = random.Random(4)
    for _ in range(40):
        g, members, generation, at = sessions.Group(), {}, 0, 0
        for _ in range(300):
            at += rng.choice([0, 0, 1, 5, -3, -40])  # times need not rise
            command = rng.choice(["join", "join", "sync", "heartbeat", "leave"]), f"m{rng.randrange(12)}", generation + rng.choice([0, 0, 1]), at
            want, generation = plain(members, generation, *command)
            assert (sessions.group_step(g, *command, 20), g.generation, g.members, g.leader()) == (want, generation, members, min(members, default=None))
    g, start = sessions.Group(), time.process_time()
    for i in range(200_000):
        sessions.group_step(g, "join", f"m{i % 20_000}", 0, i // 1000, 40_000)
        g.leader()
    assert len(g.members) == 20_000 and time.process_time() - start < 10  # a pass a command took minutes


def test_streaming_decides_as_the_batch_does(spark, tmp_path):
    rng = random.Random(8)
    rows, base = [], {}
    for i in range(200):
        k = (rng.randrange(3), rng.randrange(2))
        n = rng.randrange(1, 4)
        rows.append((*k, i, 0, base.get(k, 0) if rng.random() > 0.1 else 999, n))
        if rows[-1][4] != 999:
            base[k] = rows[-1][4] + n
            if rng.random() < 0.2:
                rows.append((*k, i + 1000, *rows[-1][3:]))
    df = spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "producer long, part long, seq long, epoch int, base long, count long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, appends.run_available(appends.decide_appends(appends.follow(spark, str(tmp_path / "in")))).collect()))
    assert got == sorted(map(tuple, sessions.decide_appends(df).collect()))


def test_reach_ends_on_cycles_and_refuses_depth(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y")], "parent string, child string")
    seeds = spark.createDataFrame([("a", "a"), ("q", "q")], "root string, node string")
    assert {(r.root, r.node, r.level) for r in graphs.reach(edges, seeds).collect()} == {("a", "a", 0), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("q", "q", 0)}
    with pytest.raises(ValueError):
        graphs.reach(edges, seeds, depth=2)


NODES = "node string, weight int, zone string, rack string, state string, reachable boolean"


def test_placement_spreads_domains_first(spark):
    nodes = spark.createDataFrame([(f"n{i}", 1 + i % 2, f"z{i % 3}", f"r{i % 5}", "in" if i else "out", i != 4) for i in range(12)], NODES)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    got: dict = {}
    for r in placement.diverse(keys, nodes, 3, ["zone", "rack"]).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(int(r.node[1:]))
    assert all(len({n % 3 for n in x}) == 3 and 0 not in x for x in got.values()) and len(got) == 50
    assert all(len({n % 5 for n in x}) == 3 for x in got.values())  # a new zone always has a new rack to offer
    with pytest.raises(ValueError):
        placement.diverse(keys, nodes, 12, ["zone"])
    asked = keys.withColumn("exclude", F.array(F.lit("n1"), F.lit("n2")))
    assert {int(r.node[1:]) % 3 for r in placement.replacements(asked, nodes, ["zone"]).collect()} == {0}
    none = keys.withColumn("exclude", F.array(*[F.lit(f"n{i}") for i in range(12)]))
    assert placement.replacements(none, nodes, ["zone"]).count() == 0


def test_rendezvous_as_sorting_all_nodes(spark):
    import hashlib

    names = [f"n{i}" for i in range(200)]
    nodes = spark.createDataFrame([(n,) for n in names], "node string")
    keys = [f"k{i}" for i in range(300)]
    got: dict = {}
    for r in placement.rendezvous(spark.createDataFrame([(k,) for k in keys], "key string"), nodes, 2).orderBy("key", "rank").collect():
        got.setdefault(r.key, []).append(r.node)
    assert got == {k: sorted(names, key=lambda n: hashlib.md5(f"{k}:{n}".encode()).hexdigest(), reverse=True)[:2] for k in keys}


def _cheapest(key, nodes, k, used=(), gone=()):
    """The greedy choices over all nodes: (name, weight, zone, rack)."""
    import hashlib

    used, out = ({z for z, _ in used}, {r for _, r in used}), []
    cost = {n: ((1 << 52) - 1 - int(hashlib.md5(f"{key}:{n}".encode()).hexdigest()[:13], 16)) / w for n, w, _, _ in nodes if n not in gone}
    for _ in range(k):
        name, _, zone, rack = min((x for x in nodes if x[0] in cost), key=lambda x: (x[2] in used[0], x[3] in used[1], cost[x[0]], x[0]))
        out.append(name)
        del cost[name]
        used[0].add(zone), used[1].add(rack)
    return out


@pytest.mark.parametrize("zones", [2, 5])
def test_placement_on_more_nodes_than_a_block(spark, zones):
    import hashlib

    nodes = [(f"n{i}", 1 + i % 3, f"z{i % zones}", f"r{i % 7 if i % 40 else i}") for i in range(40_000)]
    table = spark.createDataFrame([(*n, "in", True) for n in nodes], "node string, weight int, zone string, rack string, state string, reachable boolean")
    names = ["k1", "k22", "key of more than one block " * 3, "é", ""]
    keys = spark.createDataFrame([(k,) for k in names], "key string")

    def chosen(df):
        got: dict = {}
        for r in df.orderBy("key", "rank").collect():
            got.setdefault(r.key, []).append(r.node)
        return got

    assert chosen(placement.greedy(keys, table, 4, ["zone", "rack"])) == {k: _cheapest(k, nodes, 4) for k in names}
    gone = [f"n{i}" for i in range(1, zones)]
    asked = keys.withColumn("exclude", F.array(*map(F.lit, gone)))
    used = [(n[2], n[3]) for n in nodes if n[0] in gone]
    got = {r.key: r.node for r in placement.replacements(asked, table, ["zone", "rack"]).collect()}
    assert got == {k: _cheapest(f"repair:{k}", nodes, 1, used, gone)[0] for k in names}
    best = lambda k: sorted((n[0] for n in nodes), key=lambda n: hashlib.md5(f"{k}:{n}".encode()).hexdigest(), reverse=True)[:40]
    assert chosen(placement.rendezvous(keys, table, 40)) == {k: best(k) for k in names}


def test_nodes_are_copied_for_tasks_not_for_tasks_and_blocks(spark, monkeypatch):
    numbered, dealt = placement._numbered, []
    monkeypatch.setattr(placement, "_BLOCK", 8)
    monkeypatch.setattr(placement, "_numbered", lambda n: dealt.append(n) or numbered(n))
    nodes = [f"n{i}" for i in range(128)]
    keys = spark.createDataFrame([(f"k{i}",) for i in range(20)], "key string")
    got = placement.rendezvous(keys, spark.createDataFrame([(n,) for n in nodes], "node string"), 1).collect()
    blocks, chunks = dealt
    assert blocks == 16 and blocks * chunks <= max(8 * spark.sparkContext.defaultParallelism, blocks)
    assert len(got) == 20


def test_repair_plan_places_its_targets_once(spark, sf_dir, monkeypatch):
    from tessera.plans import QUERIES

    found, asked = placement._finder, []
    monkeypatch.setattr(placement, "_finder", lambda *a: asked.append(a) or found(*a))
    plan = QUERIES["repair_plan"](spark, sf_dir)
    assert len(asked) == 2  # the targets, and the replacements of those without a home
    assert "FlatMapCoGroups" not in plan._jdf.queryExecution().executedPlan().toString()  # what reads them five times reads what is placed


def test_repair_plan_has_tasks_for_its_pairs_not_for_other_shuffles(spark, sf_dir):
    from tessera.plans import QUERIES

    context, before = spark.sparkContext, spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "400")
    context.setJobGroup("repair_plan", "")
    try:
        QUERIES["repair_plan"](spark, sf_dir).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("repair_plan") for s in tracker.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s and s.numCompletedTasks) <= 8 * context.defaultParallelism


def test_repairs_of_missing_copies(spark):
    nodes = spark.createDataFrame([(f"n{i}", 1, f"z{i}", f"r{i}", "in", i not in (1, 2)) for i in range(5)], NODES)
    targets = spark.createDataFrame([(k, n) for k in "abcd" for n in ("n0", "n1")], "key string, node string")
    healthy = spark.createDataFrame([("a", "n0"), ("b", "n1"), ("c", "n0"), ("c", "n3"), ("d", "n0"), ("d", "n3")], "key string, node string")
    exceptions = spark.createDataFrame([("c", "n3", 100), ("d", "n3", 15)], "key string, node string, expires_at long")
    got = {(r.key, r.missing): (r.destination, r.temporary) for r in placement.plan_repairs(targets, healthy, nodes, exceptions, ["zone"], 10, 30).collect()}
    assert got.pop(("a", "n1"))[0] in {"n2", "n3", "n4"}
    assert got == {("b", "n0"): ("n0", False), ("d", "n1"): ("n3", True)}  # c has a standing copy, d's expires soon


def test_link_readers_and_headers(spark):
    readers = directory.LinkReaders()
    readers.register("list", lambda p: F.split(p, ","))
    with pytest.raises(ValueError):
        readers.register("list", lambda p: p)
    blocks = spark.createDataFrame([("a", "list", "b,c"), ("b", "list", "c")], "node string, codec string, payload string")
    assert {tuple(r) for r in readers.links(blocks).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    with pytest.raises(Exception, match="no reader"):
        readers.links(blocks.withColumn("codec", F.lit("other"))).collect()
    header = b"SQLite format 3\0" + bytes([16, 0]) + bytes(10) + (3).to_bytes(4, "big") + bytes(68)
    df = spark.createDataFrame([(bytearray(header), 3 * 4096), (bytearray(header), 4096), (bytearray(header[:99]), 0), (bytearray(b"x" + header[1:]), 3 * 4096)], "h binary, n long")
    assert [r[0] for r in df.select(directory.database_header(F.col("h"), F.col("n"))).collect()] == [None, "pages", "short", "magic"]


def test_access_rules_for_everyone(spark):
    rules = spark.createDataFrame([("*", "topic", "*", "literal", "read", "allow"), ("*", "topic", "", "prefix", "all", "allow"), ("u1", "topic", "a", "prefix", "write", "deny"), ("*", "group", "g", "literal", "read", "allow")], "principal string, resource_type string, resource string, pattern string, operation string, effect string")
    asked = [(1, "u1", "topic", "abc", "read"), (2, "u1", "topic", "abc", "write"), (3, "u2", "topic", "abc", "write"), (4, "u2", "group", "g", "read"), (5, "u2", "group", "h", "read")]
    got = access.authorize(spark.createDataFrame(asked, "request long, principal string, resource_type string, resource string, operation string"), rules)
    assert {r.request: r.allowed for r in got.collect()} == {1: True, 2: False, 3: True, 4: True, 5: False}


def test_tree_closure_and_missing_parents(spark):
    files = spark.createDataFrame([("a/b/c.txt", 3), ("a/d", 4), ("e", 5)], "path string, size long")
    tree = trees.with_ancestors(files)
    assert {(r.path, r.kind) for r in tree.collect()} == {("a", "dir"), ("a/b", "dir"), ("a/b/c.txt", "file"), ("a/d", "file"), ("e", "file")}
    assert trees.missing_parents(tree).count() == 0
    assert [r.path for r in trees.missing_parents(tree.filter("path <> 'a/b'")).collect()] == ["a/b/c.txt"]
    assert tuple(trees.counters(tree).first()) == (3, 3, 12)


def test_checksums_and_batches():
    assert codec.crc32c_of([b"123456789", b"", b"\0" * 32]).tolist() == [0xE3069283, 0, 0x8A9136AA]
    batch = codec.encode_batch(40, 9, [{"delta": 0, "ts": 5, "key": b"k", "value": None}, {"delta": 3, "ts": 2, "key": None, "value": b"v" * 200}])
    (sound,) = codec.sealed([batch])
    assert codec.faults_of([sound, sound[:-1], sound[:-1] + b"?", b"x"]) == [None, "length", "crc", "length"]
    assert list(codec.decode_batch(sound)) == [(40, 5, 9, b"k", None), (43, 2, 9, None, b"v" * 200)]


def test_erasure_restores_from_any_four():
    for payload in (b"", b"x", bytes(range(256)) * 3):
        shards = erasure.encode(payload, 4, 2)
        for some in itertools.combinations(range(6), 4):
            assert erasure.restore({i: shards[i] for i in some}, len(payload), 4, 2) == payload
    assert erasure.restore({0: b"x"}, 1, 4, 2) is None


def test_text_functions(spark):
    row = spark.range(1).select(
        text.uri_encode(F.lit("a b/~*é")).alias("a"), text.uri_encode(F.lit("a b/~"), keep_slash=True).alias("b"), text.percent_decode(F.lit("a+b%20c")).alias("c"), text.percent_decode(F.lit("%zz")).alias("d"),
        text.decode_token(text.encode_token(last=F.lit("k/1"), n=F.lit(3)), "last string, n int").alias("t"), text.etag_passes(F.lit("e"), F.lit('"x", "e"'), F.lit(None)).alias("m"),
        text.etag_passes(F.lit("e"), F.lit('"x"'), F.lit(None)).alias("n"), text.etag_passes(F.lit("e"), F.lit(None), F.lit("*")).alias("o"),
        text.user_metadata(F.create_map(F.lit("X-Amz-Meta-Who"), F.lit("me"), F.lit("Host"), F.lit("h"))).alias("u"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("a%20b%2F~%2A%C3%A9", "a%20b/~", "a+b c", None)
    assert tuple(row.t) == ("k/1", 3) and (row.m, row.n, row.o) == (200, 412, 304) and row.u == {"who": "me"}


def test_record_batches_are_read_by_few(spark):
    import pyarrow as pa

    full = pa.RecordBatch.from_arrays([pa.array(range(10_000))], names=["n"])
    parts = list(codec._parts(iter([full, full.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= 256 and [n for p in parts for n in p.column(0).to_pylist()] == list(range(10_000))
    rows = [(0, i // 2 * 2, 5, i, i % 7, None if i % 3 else f"k{i}", None if i % 5 else "v") for i in range(2_000)]
    df = spark.createDataFrame(rows, "part long, base_offset long, producer long, offset long, ts long, key string, value string").coalesce(1)
    batches = codec.encode_batches(df)
    got = codec.decode_batches(batches).select("offset", "ts", "producer", F.col("key").cast("string"), F.col("value").cast("string")).collect()
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in got) == sorted(((i, t, p, k, v) for _, _, p, i, t, k, v in rows))
    bad = F.when(F.col("base_offset") % 600 == 0, F.lit(b"x")).otherwise(F.col("batch"))
    assert {(r.base_offset, r.fault) for r in codec.faults(batches.withColumn("batch", bad)).collect()} == {(b, "length") for b in (0, 600, 1200, 1800)}
