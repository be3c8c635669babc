"""Queries over catalogue tables and the checks of manifests, headers, jobs and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import directory, graphs
from ..sources.tables import EDGES_SQL, RECORDS_SQL, TXNS_SQL, edges, log_records, table, transactions
from .registry import query

_NAMESPACES = """namespaces AS (SELECT c_custkey AS id, c_name AS alias, CASE c_custkey % 3 WHEN 0 THEN 'bucket' WHEN 1 THEN 'filesystem' ELSE 'database' END AS kind, c_custkey % 17 = 3 AS deleted FROM customer)"""
_UPLOADS = """uploads AS (SELECT o_orderkey AS upload, o_custkey AS bucket, 'k' || CAST(o_orderkey % 7 AS VARCHAR) AS key, CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'completing' ELSE 'done' END AS status,
  CASE WHEN o_orderkey % 5 > 0 THEN md5(CAST(o_orderkey AS VARCHAR)) END AS final FROM orders)"""


def _namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), F.col("c_name").alias("alias"), F.when(k % 3 == 0, "bucket").when(k % 3 == 1, "filesystem").otherwise("database").alias("kind"), (k % 17 == 3).alias("deleted"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), F.col("o_orderstatus")
    status = F.when(s == "O", "open").when(s == "P", "completing").otherwise("done")
    return table(spark, sf_dir, "orders").select(k.alias("upload"), F.col("o_custkey").alias("bucket"), F.concat(F.lit("k"), (k % 7).cast("string")).alias("key"), status.alias("status"), F.when(k % 5 > 0, F.md5(k.cast("string"))).alias("final"))


@query(f"""WITH {_NAMESPACES}, q AS (SELECT o_orderkey AS request, CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') ELSE 'none' END AS asked FROM orders)
SELECT request, asked, coalesce(a.id, b.id) AS id FROM q LEFT JOIN namespaces a ON CAST(a.id AS VARCHAR) = asked LEFT JOIN namespaces b ON b.alias = asked""")
def namespace_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    asked = F.when(k % 3 == 0, c).when(k % 3 == 1, F.concat(F.lit("Customer#"), F.lpad(c, 9, "0"))).otherwise("none")
    return directory.resolve(table(spark, sf_dir, "orders").select(k.alias("request"), asked.alias("asked")), _namespaces(spark, sf_dir))


@query(f"WITH {_NAMESPACES} SELECT id, alias FROM namespaces WHERE kind = 'bucket' AND NOT deleted")
def bucket_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _namespaces(spark, sf_dir)
    return directory.live_buckets(n, n.filter("deleted"))


@query("""WITH wanted AS (SELECT o_orderkey AS seq, 'b' || CAST(o_custkey * 3 % 1000 AS VARCHAR) AS name FROM orders), existing AS (SELECT 'b' || CAST(s_suppkey AS VARCHAR) AS name FROM supplier)
SELECT seq, name, name NOT IN (SELECT name FROM existing) AND seq = min(seq) OVER (PARTITION BY name) AS accepted FROM wanted""")
def bucket_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.concat(F.lit("b"), (F.col("o_custkey") * 3 % 1000).cast("string")).alias("name"))
    existing = table(spark, sf_dir, "supplier").select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("name"))
    return directory.create(wanted, existing).select("seq", "name", "accepted")


@query(f"""WITH {_UPLOADS}, objects AS (SELECT o_custkey AS bucket, o_orderkey % 4 > 0 AS tombstone FROM orders)
SELECT c_custkey AS bucket FROM customer WHERE c_custkey NOT IN (SELECT bucket FROM objects WHERE NOT tombstone) AND c_custkey NOT IN (SELECT bucket FROM uploads WHERE status = 'open')""")
def bucket_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("bucket"), (F.col("o_orderkey") % 4 > 0).alias("tombstone"))
    return directory.deletable(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("bucket")), objects, _uploads(spark, sf_dir))


@query(f"WITH {_UPLOADS} SELECT bucket, count(*) AS uploads, count(*) FILTER (status = 'open' AND key LIKE 'k1%') AS listed, min(upload) FILTER (key = 'k3') AS first_k3 FROM uploads GROUP BY bucket")
def upload_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _uploads(spark, sf_dir)
    return u.groupBy("bucket").agg(F.count(F.lit(1)).alias("uploads"), F.count_if((F.col("status") == "open") & F.col("key").startswith("k1")).alias("listed"), F.min(F.when(F.col("key") == "k3", F.col("upload"))).alias("first_k3"))


@query(f"""WITH {_UPLOADS}, head AS (SELECT bucket, key, arg_max(final, upload) AS content FROM uploads WHERE final IS NOT NULL GROUP BY bucket, key)
SELECT u.upload FROM uploads u JOIN head h ON h.bucket = u.bucket AND h.key = u.key AND h.content = u.final WHERE status = 'completing'""")
def upload_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _uploads(spark, sf_dir)
    head = u.filter("final is not null").groupBy("bucket", "key").agg(F.max_by("final", "upload").alias("content"))
    return directory.reconcilable(u, head).select("upload")


@query("SELECT l_orderkey AS bucket, max(l_linenumber) AS epoch, arg_max(l_suppkey, ROW(l_linenumber, l_suppkey)) AS owner, count(*) AS epochs FROM lineitem GROUP BY l_orderkey")
def partition_map_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("bucket"))
    return rows.agg(F.max("l_linenumber").alias("epoch"), F.max_by("l_suppkey", F.struct("l_linenumber", "l_suppkey")).alias("owner"), F.count(F.lit(1)).alias("epochs"))


@query("""WITH topics AS (SELECT p_brand AS topic, p_size AS part, min(p_partkey) AS leader FROM part GROUP BY 1, 2), asked AS (SELECT DISTINCT p_brand AS topic FROM part UNION ALL SELECT c_mktsegment FROM customer GROUP BY 1)
SELECT asked.topic, part, leader, part IS NOT NULL AS known FROM asked LEFT JOIN topics ON topics.topic = asked.topic""")
def topic_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    topics = part.groupBy(F.col("p_brand").alias("topic"), F.col("p_size").alias("part")).agg(F.min("p_partkey").alias("leader"))
    asked = part.select(F.col("p_brand").alias("topic")).distinct().union(table(spark, sf_dir, "customer").select("c_mktsegment").distinct())
    return directory.metadata(asked, topics)


@query("SELECT p_brand AS topic, p_size AS part FROM part WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_partkey % 97 = 5)")
def topic_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(F.col("p_brand").alias("topic"), F.col("p_size").alias("part")).join(part.filter("p_partkey % 97 = 5").select(F.col("p_brand").alias("topic")), "topic", "left_anti")


@query("SELECT 'g' || CAST(o_custkey % 300 AS VARCHAR) AS \"group\", count(*) AS offsets, max(o_orderkey) AS latest FROM orders GROUP BY 1")
def group_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.concat(F.lit("g"), (F.col("o_custkey") % 300).cast("string"))
    return table(spark, sf_dir, "orders").groupBy(group.alias("group")).agg(F.count(F.lit(1)).alias("offsets"), F.max("o_orderkey").alias("latest")).orderBy("group")


@query("""SELECT p_partkey AS topic, name, value FROM (SELECT p_partkey, unnest(['size', 'brand', 'type']) AS name, unnest([CAST(p_size AS VARCHAR), p_brand, p_type]) AS value FROM part) x WHERE name <> 'type' OR p_partkey % 2 = 0""")
def config_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("topic"), F.explode(config).alias("name", "value")).filter((F.col("name") != "type") | (F.col("topic") % 2 == 0))


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('signup', 'click') AND value < 50")
def publication_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("event_type in ('signup', 'click') and value < 50").select("event_id", "event_type")


@query("SELECT user_id AS block, max(event_id) AS receipt, arg_max(event_type, event_id) AS state FROM events GROUP BY user_id")
def receipts_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("block")).agg(F.max("event_id").alias("receipt"), F.max_by("event_type", "event_id").alias("state"))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS cid, l_suppkey AS node, l_shipdate AS until FROM lineitem) SELECT cid, count(DISTINCT node) AS providers, min(node) AS first FROM p WHERE until > TIMESTAMP '1995-06-01 00:00:00' GROUP BY cid""")
def block_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    alive = table(spark, sf_dir, "lineitem").filter("l_shipdate > timestamp_ntz '1995-06-01 00:00:00'")
    return alive.groupBy(F.col("l_partkey").alias("cid")).agg(F.count_distinct("l_suppkey").alias("providers"), F.min("l_suppkey").alias("first"))


_SHARDS = "m AS (SELECT o_orderkey AS object, 2 + o_orderkey % 3 AS data, [md5(o_orderkey || '/' || i) for i in range(0, 4 + o_orderkey % 3)] AS shards FROM orders)"


@query(f"""WITH {_SHARDS}, s AS (SELECT object, data, unnest(shards) AS cid FROM m), c AS (SELECT object, data, count(*) AS shards, count(*) FILTER (substr(cid, 1, 1) > '3') AS present FROM s GROUP BY object, data)
SELECT object, shards, present, CASE WHEN present = shards THEN 'healthy' WHEN present >= data THEN 'degraded' ELSE 'lost' END AS health FROM c""")
def erasure_shard_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    cids = F.transform(F.sequence(F.lit(0).cast("bigint"), k % 3 + 3), lambda i: F.md5(F.concat(k.cast("string"), F.lit("/"), i.cast("string"))))
    manifests = table(spark, sf_dir, "orders").select(k.alias("object"), (k % 3 + 2).alias("data"), cids.alias("shards"))
    inventory = manifests.select(F.explode("shards").alias("cid")).filter(F.substring("cid", 1, 1) > "3")
    return directory.shard_health(manifests, inventory)


@query("""WITH l AS (SELECT l_orderkey AS object, l_linenumber, CAST(l_quantity AS BIGINT) AS length, coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_linenumber * 7 AS l_quantity FROM lineitem) y),
m AS (SELECT object, sum(length) AS total, count(*) AS top FROM l GROUP BY object)
SELECT object, CASE WHEN object % 11 = 1 THEN 'counts' WHEN object % 13 = 2 AND top > 1 THEN 'gap' WHEN object % 7 = 3 THEN 'size' WHEN object % 5 = 4 THEN 'shards' END AS fault FROM m
WHERE object % 11 = 1 OR (object % 13 = 2 AND top > 1) OR object % 7 = 3 OR object % 5 = 4""")
def erasure_manifest_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), "l_linenumber").distinct()
    o = F.col("object")
    ordered = lines.groupBy("object").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"))
    lengths = F.transform("n", lambda x: (x * 7).cast("bigint"))
    offset = lambda i: F.aggregate(F.slice(lengths, 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x)
    shift = F.when((o % 13 == 2) & (F.size("n") > 1), 1).otherwise(0)
    stripes = F.transform(lengths, lambda x, i: F.struct((offset(i) + F.when(i == 1, shift).otherwise(0)).alias("offset"), x.alias("length"), F.when((o % 5 == 4) & (i == 0), 5).otherwise(6).alias("shards")))
    total = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return directory.erasure_faults(ordered.select("object", F.when(o % 11 == 1, 0).otherwise(4).alias("data"), F.lit(2).alias("parity"), stripes.alias("stripes"), (total + F.when(o % 7 == 3, 1).otherwise(0)).alias("size")))


@query("""SELECT o_orderkey AS job, CASE WHEN o_orderkey % 19 = 0 THEN 'entry' WHEN o_orderkey % 17 = 0 THEN 'no inputs' WHEN o_orderkey % 13 = 0 THEN 'inputs repeat' WHEN o_orderkey % 11 = 0 THEN 'outputs repeat'
  WHEN o_custkey % 50 = 0 THEN 'memory' WHEN o_orderkey % 7 = 0 THEN 'timeout' END AS fault FROM orders
WHERE o_orderkey % 19 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 OR o_custkey % 50 = 0 OR o_orderkey % 7 = 0""")
def job_spec_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("o_orderkey"), lambda *x: F.array(*map(F.lit, x))
    inputs = F.when(k % 17 == 0, s().cast("array<string>")).when(k % 13 == 0, s("a", "b", "a")).otherwise(s("a", "b"))
    jobs = table(spark, sf_dir, "orders").select(k.alias("job"), F.when(k % 19 == 0, "9 x").otherwise("run_all").alias("entry"), inputs.alias("inputs"), F.when(k % 11 == 0, s("o", "o")).otherwise(s("o")).alias("outputs"),
        F.when(F.col("o_custkey") % 50 == 0, 5000).otherwise(64).alias("memory_mb"), F.when(k % 7 == 0, 0).otherwise(60).alias("timeout_s"))
    return directory.job_faults(jobs)


@query("""SELECT p_partkey AS file, CASE WHEN p_partkey % 13 = 1 THEN 'short' WHEN p_partkey % 11 = 2 THEN 'magic' WHEN p_size % 7 = 3 THEN 'page size' WHEN p_partkey % 5 = 4 THEN 'size' WHEN p_partkey % 3 = 1 THEN 'pages' END AS fault FROM part""")
def database_header_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    page = F.when(F.col("p_size") % 7 == 3, "1001").when(F.col("p_size") % 7 == 4, "0001").otherwise("1000")
    bytes_ = F.when(page == "0001", 65536).otherwise(4096)
    pages = k % 100 + 1
    count = pages + F.when(k % 3 == 1, 1).otherwise(0)
    text = F.concat(F.when(k % 11 == 2, "54").otherwise("53"), F.lit("514C69746520666F726D6174203300"), page, F.lit("00" * 10), F.lpad(F.hex(count), 8, "0"), F.repeat(F.lit("00"), F.when(k % 13 == 1, 10).otherwise(68)))
    files = table(spark, sf_dir, "part").select(k.alias("file"), F.unhex(text).alias("header"), (pages * bytes_ + F.when(k % 5 == 4, 1).otherwise(0)).alias("size"))
    return files.select("file", directory.database_header(F.col("header"), F.col("size")).alias("fault"))


@query(f"""WITH {EDGES_SQL}, n AS (SELECT parent AS node FROM edges UNION SELECT child FROM edges), k AS (SELECT parent AS node, count(*) AS links FROM edges GROUP BY 1)
SELECT n.node, CASE WHEN NOT starts_with(n.node, 'r') AND n.node NOT IN (SELECT e.child FROM edges e JOIN (SELECT 'r1' AS x UNION ALL SELECT child FROM edges WHERE parent = 'r1' UNION ALL SELECT b.child FROM edges a JOIN edges b ON b.parent = a.child WHERE a.parent = 'r1') up ON e.parent = up.x) THEN 'unreachable'
  WHEN starts_with(n.node, 'r') AND n.node <> 'r1' THEN 'unreachable' WHEN coalesce(links, 0) > 12 THEN 'links' WHEN starts_with(n.node, 'o') THEN 'depth' END AS fault
FROM n LEFT JOIN k ON k.node = n.node WHERE fault IS NOT NULL""")
def tree_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = edges(spark, sf_dir)
    depths = graphs.reach(e, spark.createDataFrame([("r1", "r1")], "root string, node string")).select("node", "level")
    return directory.tree_faults(e, depths, 2, 12)


@query(r"""WITH b AS (SELECT page_id, page_id % 3 AS codec, html, url FROM pages)
SELECT page_id AS parent, unnest(CASE codec WHEN 0 THEN regexp_extract_all(html, 'href="([^"]*)"', 1) WHEN 1 THEN string_split(url, '/') ELSE [] END) AS child FROM b""")
def codec_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    readers = directory.LinkReaders()
    readers.register("html", lambda p: F.regexp_extract_all(p, F.lit('href="([^"]*)"'), F.lit(1)))
    readers.register("path", lambda p: F.split(p, "/"))
    readers.register("raw", lambda p: F.array().cast("array<string>"))
    i = F.col("page_id")
    blocks = table(spark, sf_dir, "pages").select(i.alias("node"), F.when(i % 3 == 0, "html").when(i % 3 == 1, "path").otherwise("raw").alias("codec"), F.when(i % 3 == 0, F.col("html")).otherwise(F.col("url")).alias("payload"))
    return readers.links(blocks)


@query("""WITH v AS (SELECT DISTINCT source, sha256(coalesce(text, '')) AS node, doc_id % 4 = 3 AS later FROM documents), t AS (SELECT source, node, bool_and(later) AS fresh, bool_or(later) AS has FROM v GROUP BY 1, 2)
SELECT source, count(*) FILTER (has) AS total, count(*) FILTER (fresh) AS written, CASE WHEN count(*) FILTER (has) > 0 THEN CAST(count(*) FILTER (has) - count(*) FILTER (fresh) AS DOUBLE) / count(*) FILTER (has) ELSE 0.0 END AS ratio FROM t GROUP BY source""")
def sharing_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    later = F.col("doc_id") % 4 == 3
    nodes = table(spark, sf_dir, "documents").groupBy("source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("node")).agg(F.every(later).alias("fresh"), F.some(later).alias("has"))
    counts = nodes.groupBy("source").agg(F.count_if("has").alias("total"), F.count_if("fresh").alias("written"))
    return counts.withColumn("ratio", directory.sharing_ratio(F.col("written"), F.col("total")))


@query(f"WITH {RECORDS_SQL}, {TXNS_SQL} SELECT part, count(*) AS transactions, count(*) FILTER (status = 'ongoing') AS ongoing, count(*) FILTER (status = 'aborted') AS aborted, count(DISTINCT producer) AS producers FROM txns GROUP BY part")
def transaction_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = transactions(log_records(spark, sf_dir))
    return t.groupBy("part").agg(F.count(F.lit(1)).alias("transactions"), F.count_if(F.col("status") == "ongoing").alias("ongoing"), F.count_if(F.col("status") == "aborted").alias("aborted"), F.count_distinct("producer").alias("producers"))
