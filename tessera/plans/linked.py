"""Queries over graphs, placement, access rules and stateful folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import access, graphs, placement, sessions
from ..sources.tables import EDGES_SQL, edges, log_records, table
from .registry import query

_SEEDS = ("r0", "r3", "n7")
_REACH = f"""{EDGES_SQL}, seeds(root) AS (VALUES {', '.join(f"('{s}')" for s in _SEEDS)})"""
_WALK = "reach AS (SELECT root, root AS node, 0 AS level FROM seeds UNION ALL SELECT r.root, e.child, r.level + 1 FROM reach r JOIN edges e ON e.parent = r.node)"
_NODES = """blocks AS (SELECT DISTINCT node, length(node) * 100 AS size, node LIKE '%9' AS corrupt FROM (SELECT parent AS node FROM edges UNION ALL SELECT child FROM edges) x)"""


def _reached(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(s, s) for s in _SEEDS], "root string, node string")
    return graphs.reach(edges(spark, sf_dir), seeds)


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("parent").alias("node")).union(e.select("child")).distinct()
    return nodes.select("node", (F.length("node") * 100).cast("bigint").alias("size"), F.col("node").endswith("9").alias("corrupt"))


@query(f"WITH RECURSIVE {_REACH}, {_WALK} SELECT root, node, min(level) AS level FROM reach GROUP BY root, node")
def dag_reach(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reached(spark, sf_dir)


@query(f"WITH RECURSIVE {_REACH}, {_WALK}, {_NODES} SELECT * FROM blocks WHERE NOT corrupt AND node NOT IN (SELECT node FROM reach)")
def gc_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.sweep(_blocks(spark, sf_dir), _reached(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REACH}, {_WALK}, {_NODES}, m AS (SELECT b.*, node IN (SELECT node FROM reach) AS kept FROM blocks b)
SELECT count(*) FILTER (kept) AS protected, count(*) FILTER (NOT kept AND NOT corrupt) AS deleted, CAST(coalesce(sum(size) FILTER (NOT kept AND NOT corrupt), 0) AS BIGINT) AS reclaimed_bytes FROM m""")
def gc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.sweep_report(_blocks(spark, sf_dir), _reached(spark, sf_dir))


@query(f"""WITH RECURSIVE {_REACH}, {_WALK}, {_NODES} SELECT b.node, r.root, CASE WHEN level = 0 THEN 'root' WHEN level > 0 THEN 'descendant' END AS relation
FROM blocks b LEFT JOIN (SELECT root, node, min(level) AS level FROM reach GROUP BY 1, 2) r ON r.node = b.node""")
def gc_explain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.explain(_reached(spark, sf_dir), _blocks(spark, sf_dir).select("node"))


@query(f"WITH RECURSIVE {_REACH}, {_WALK}, {_NODES} SELECT root, count(*) AS nodes, CAST(sum(size) AS BIGINT) AS bytes FROM (SELECT DISTINCT root, node FROM reach) r JOIN blocks USING (node) GROUP BY root")
def dag_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.logical_sizes(_reached(spark, sf_dir), _blocks(spark, sf_dir))


@query(f"WITH {EDGES_SQL} SELECT parent, count(*) AS links, min(child) AS first_child FROM edges GROUP BY parent")
def dag_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges(spark, sf_dir).groupBy("parent").agg(F.count(F.lit(1)).alias("links"), F.min("child").alias("first_child"))


@query("SELECT conv_id AS key, turn AS version, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) - 1 AS age FROM (SELECT DISTINCT conv_id, turn FROM conversations) c")
def version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = graphs.version_chain(table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("version")).distinct())
    return chain.withColumn("age", F.col("age").cast("bigint"))


@query("SELECT DISTINCT sha256(text) AS node FROM documents WHERE doc_id % 10 >= 4 EXCEPT SELECT sha256(text) FROM documents WHERE doc_id % 10 < 4")
def merkle_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("node"))
    return graphs.new_frontier(d.filter("doc_id % 10 < 4"), d.filter("doc_id % 10 >= 4"))


@query("""SELECT l_orderkey AS job, l_suppkey AS node, CAST(l_quantity AS BIGINT) AS local_bytes, l_linenumber AS queue_delay, l_partkey % 5 AS parallelism,
 row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(l_quantity AS BIGINT) DESC, l_linenumber, l_partkey % 5 DESC, l_suppkey) AS rank FROM lineitem""")
def offer_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    offers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.col("l_suppkey").alias("node"), F.col("l_quantity").cast("bigint").alias("local_bytes"), F.col("l_linenumber").alias("queue_delay"), (F.col("l_partkey") % 5).alias("parallelism"))
    return placement.rank_offers(offers).withColumn("rank", F.col("rank").cast("bigint"))


_RULES = [
    ("u1", "topic", "click", "literal", "read", "allow"), ("u2", "topic", "*", "literal", "all", "allow"), ("*", "topic", "p", "prefix", "read", "allow"),
    ("u3", "topic", "pur", "prefix", "all", "deny"), ("u4", "topic", "", "prefix", "write", "allow"), ("u2", "topic", "error", "literal", "write", "deny"), ("*", "group", "view", "literal", "all", "allow"),
]


@query(f"""WITH rules(principal, resource_type, resource, pattern, operation, effect) AS (VALUES {', '.join(str(r) for r in _RULES)}),
q AS (SELECT event_id AS request, 'u' || CAST(user_id % 6 AS VARCHAR) AS principal, CASE WHEN event_id % 11 = 0 THEN 'group' ELSE 'topic' END AS resource_type, event_type AS resource,
             CASE WHEN event_id % 2 = 0 THEN 'read' ELSE 'write' END AS operation FROM events),
h AS (SELECT request, bool_or(effect = 'deny') AS denied, bool_or(effect = 'allow') AS granted FROM q JOIN rules r ON r.resource_type = q.resource_type
  AND (r.principal = '*' OR r.principal = q.principal) AND (r.operation = 'all' OR r.operation = q.operation)
  AND CASE r.pattern WHEN 'literal' THEN r.resource = '*' OR r.resource = q.resource ELSE starts_with(q.resource, r.resource) END GROUP BY request)
SELECT q.request, coalesce(granted, false) AND NOT coalesce(denied, false) AS allowed FROM q LEFT JOIN h USING (request)""")
def acl_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(_RULES, "principal string, resource_type string, resource string, pattern string, operation string, effect string")
    i = F.col("event_id")
    requests = table(spark, sf_dir, "events").select(i.alias("request"), F.concat(F.lit("u"), (F.col("user_id") % 6).cast("string")).alias("principal"), F.when(i % 11 == 0, "group").otherwise("topic").alias("resource_type"), F.col("event_type").alias("resource"), F.when(i % 2 == 0, "read").otherwise("write").alias("operation"))
    return access.authorize(requests, rules)


@query("""WITH RECURSIVE q AS (SELECT user_id % 32 AS key, event_id AS seq, CAST(floor(epoch(ts)) AS BIGINT) * 10 AS ms, CAST(length(props) AS BIGINT) AS bytes,
  row_number() OVER (PARTITION BY user_id % 32 ORDER BY event_id) AS i FROM events),
f AS (SELECT key, i, seq, ms, bytes <= 64 AS admitted, 64 - CASE WHEN bytes <= 64 THEN bytes ELSE 0 END AS tokens FROM q WHERE i = 1
  UNION ALL SELECT key, i, seq, ms, bytes <= t, t - CASE WHEN bytes <= t THEN bytes ELSE 0 END
  FROM (SELECT q.*, least(64, f.tokens + greatest(0, q.ms - f.ms) * 5 // 1000) AS t FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1) n)
SELECT key, seq, admitted, CAST(tokens AS BIGINT) AS tokens FROM f""")
def quota_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import seconds

    requests = table(spark, sf_dir, "events").select((F.col("user_id") % 32).alias("key"), F.col("event_id").alias("seq"), (seconds("ts") * 10).alias("at"), F.length("props").cast("bigint").alias("bytes"))
    return access.admit(requests, 5, 64)


def _appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of ten records a producer and partition, every tenth sent twice, at once."""
    batches = log_records(spark, sf_dir).groupBy("part", "producer", F.floor(F.col("offset") / 10).alias("b")).agg(F.count(F.lit(1)).alias("count"))
    from pyspark.sql import Window

    at = Window.partitionBy("part", "producer").orderBy("b")
    sums = F.sum("count").over(at.rowsBetween(Window.unboundedPreceding, -1))
    numbered = batches.withColumn("base", F.coalesce(sums, F.lit(0)))
    return numbered.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("b") % 10 == 0, 1).otherwise(0)))).select("producer", "part", (F.col("b") * 2 + F.col("copy")).alias("seq"), F.lit(0).alias("epoch"), "base", "count")


@query("""WITH records AS (SELECT user_id % 4 AS part, user_id % 8 AS producer, row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1 AS o FROM events),
b AS (SELECT DISTINCT part, producer, o // 10 AS b FROM records), c AS (SELECT *, unnest(range(0, CASE WHEN b % 10 = 0 THEN 2 ELSE 1 END)) AS copy FROM b)
SELECT producer, part, b * 2 + copy AS seq, CASE WHEN copy = 1 THEN 'duplicate' ELSE 'append' END AS decision FROM c""")
def idempotent_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.decide_appends(_appends(spark, sf_dir))


_STATE = "(SELECT user_id % 8 AS producer, event_id AS seq, CASE event_id % 7 WHEN 0 THEN 'begin' WHEN 5 THEN 'commit' WHEN 6 THEN 'abort' WHEN 3 THEN 'expire' ELSE 'append' END AS op, user_id % 4 AS part, CAST(floor(epoch(ts)) AS BIGINT) AS moment, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events)"


@query(f"""WITH RECURSIVE q AS {_STATE},
f AS (SELECT producer, 0::BIGINT AS i, 0::BIGINT AS seq, 'empty' AS state, []::BIGINT[] AS parts, 0::BIGINT AS deadline, 'empty' AS status, []::BIGINT[] AS aborted FROM q WHERE i = 1
  UNION ALL SELECT q.producer, q.i, q.seq,
    CASE WHEN op = 'begin' THEN 'ongoing' WHEN ends THEN closed ELSE state END,
    CASE WHEN op = 'begin' OR ends THEN [] WHEN op = 'append' AND state = 'ongoing' AND NOT list_contains(parts, part) THEN list_append(parts, part) ELSE parts END,
    CASE WHEN op = 'begin' OR (op = 'append' AND state = 'ongoing') THEN moment + 900 ELSE deadline END,
    CASE WHEN op = 'begin' THEN 'ongoing' WHEN ends THEN closed WHEN op IN ('commit', 'abort') AND state <> closed THEN 'error' ELSE state END,
    CASE WHEN ends AND closed = 'aborted' THEN list_sort(parts) ELSE [] END
  FROM (SELECT f.state, f.parts, f.deadline, q.*, CASE WHEN op = 'commit' THEN 'committed' ELSE 'aborted' END AS closed,
          f.state = 'ongoing' AND (op IN ('commit', 'abort') OR (op = 'expire' AND f.deadline <= q.moment)) AS ends FROM f JOIN q ON q.producer = f.producer AND q.i = f.i + 1) q)
SELECT producer, seq, status, aborted FROM f WHERE i > 0""")
def transaction_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import seconds

    i = F.col("event_id")
    op = F.when(i % 7 == 0, "begin").when(i % 7 == 5, "commit").when(i % 7 == 6, "abort").when(i % 7 == 3, "expire").otherwise("append")
    commands = table(spark, sf_dir, "events").select((F.col("user_id") % 8).alias("producer"), i.alias("seq"), op.alias("op"), (F.col("user_id") % 4).alias("part"), i.alias("offset"), seconds("ts").alias("at"))
    return sessions.fold_transactions(commands, 900)


@query("""WITH RECURSIVE q AS (SELECT 'g' || CAST(user_id % 20 AS VARCHAR) AS "group", event_id AS seq, CASE WHEN event_id % 5 < 2 THEN 'join' WHEN event_id % 5 = 2 THEN 'sync' WHEN event_id % 5 = 3 THEN 'heartbeat' ELSE 'leave' END AS op,
  'm' || CAST(user_id AS VARCHAR) AS member, event_id % 9 AS asked, CAST(floor(epoch(ts)) AS BIGINT) AS moment, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS i FROM events),
f AS (SELECT "group", 0::BIGINT AS i, 0::BIGINT AS seq, '' AS result, 0::BIGINT AS gen, []::STRUCT(m VARCHAR, seen BIGINT)[] AS members FROM q WHERE i = 1
  UNION ALL SELECT "group", i, seq, result,
    gen + CASE WHEN op = 'join' OR (op = 'leave' AND result = 'ok') THEN 1 ELSE 0 END,
    CASE WHEN result = 'ok' THEN list_concat(list_filter(alive, lambda x: x.m <> member), CASE WHEN op = 'leave' THEN [] ELSE [{'m': member, 'seen': moment}] END) ELSE alive END
  FROM (SELECT *, CASE WHEN op = 'join' THEN 'ok' WHEN NOT list_contains(list_transform(alive, lambda x: x.m), member) THEN 'unknown' WHEN op = 'leave' THEN 'ok'
          WHEN asked <> gen OR (op = 'sync' AND member <> list_min(list_transform(alive, lambda x: x.m))) THEN 'fenced' ELSE 'ok' END AS result
        FROM (SELECT q.* REPLACE (gen + len(members) - len(alive) AS gen) FROM (SELECT q.*, f.gen, f.members, list_filter(f.members, lambda x: q.moment - x.seen <= 40000) AS alive
              FROM f JOIN q ON q."group" = f."group" AND q.i = f.i + 1) q) r) n)
SELECT "group", seq, result, CAST(gen AS BIGINT) AS generation_now, CAST(len(members) AS BIGINT) AS members, list_min(list_transform(members, lambda x: x.m)) AS leader FROM f WHERE i > 0""")
def group_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import seconds

    i = F.col("event_id")
    op = F.when(i % 5 < 2, "join").when(i % 5 == 2, "sync").when(i % 5 == 3, "heartbeat").otherwise("leave")
    commands = table(spark, sf_dir, "events").select(F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string")).alias("group"), i.alias("seq"), op.alias("op"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member"), (i % 9).alias("generation"), seconds("ts").alias("at"))
    return sessions.fold_groups(commands, 40_000)
