"""Queries over catalogues, leases, uploads, pages and jobs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.lineage import new_path
from ..operators import catalogue, kv, log, objects, versions
from ..sources.tables import BATCHES_SQL, CHANGES_SQL, RECORDS_SQL, REVISION_AT, changes, log_batches, log_records, revision_at, seconds, table
from .keyed import _live
from .registry import query


@query("""WITH w AS (SELECT 't' || CAST(n_nationkey AS VARCHAR) AS topic, n_nationkey % 4 AS partitions, n_nationkey % 6 + 1 AS replication, n_nationkey % 3 + 1 AS min_isr FROM nation),
ok AS (SELECT * FROM w WHERE topic NOT IN ('t3', 't7') AND partitions > 0 AND replication <= 5 AND min_isr <= replication),
p AS (SELECT topic, replication, unnest(range(0, partitions)) AS part FROM ok)
SELECT topic, CAST(part AS INTEGER) AS part, 1 + part % 5 AS leader, array_to_string([1 + (part + j) % 5 FOR j IN range(0, replication)], ',') AS replicas FROM p""")
def topic_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    wanted = table(spark, sf_dir, "nation").select(F.concat(F.lit("t"), k.cast("string")).alias("topic"), (k % 4).alias("partitions"), (k % 6 + 1).alias("replication"), (k % 3 + 1).alias("min_isr"))
    made = catalogue.create_topics(wanted, wanted.filter("topic in ('t3', 't7')"), [1, 2, 3, 4, 5])
    return made.select("topic", "part", F.col("leader").cast("bigint").alias("leader"), F.array_join(F.transform("replicas", lambda r: r.cast("string")), ",").alias("replicas"))


@query("""WITH c AS (SELECT 't' || CAST(s_nationkey AS VARCHAR) AS topic, 'k' || CAST(s_suppkey % 3 AS VARCHAR) AS name, max(s_name) AS value FROM supplier GROUP BY 1, 2),
n AS (SELECT topic, name, CASE WHEN name = 'k1' THEN NULL ELSE 'new' END AS value FROM c WHERE topic LIKE '%1' UNION ALL SELECT 'tx', 'k0', 'new')
SELECT coalesce(c.topic, n.topic) AS topic, coalesce(c.name, n.name) AS name, CASE WHEN n.topic IS NULL THEN c.value ELSE n.value END AS value
FROM c FULL JOIN n ON n.topic = c.topic AND n.name = c.name WHERE CASE WHEN n.topic IS NULL THEN c.value ELSE n.value END IS NOT NULL""")
def topic_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    current = s.groupBy(F.concat(F.lit("t"), F.col("s_nationkey").cast("string")).alias("topic"), F.concat(F.lit("k"), (F.col("s_suppkey") % 3).cast("string")).alias("name")).agg(F.max("s_name").alias("value"))
    new = current.filter("topic like '%1'").select("topic", "name", F.when(F.col("name") != "k1", F.lit("new")).alias("value"))
    return catalogue.alter_configs(current, new.union(spark.createDataFrame([("tx", "k0", "new")], "topic string, name string, value string")))


@query("SELECT c_custkey, CAST('0x' || substr(sha256(c_name), 1, 8) AS BIGINT) % 12 AS shard FROM customer")
def coordinator_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", catalogue.shard(F.col("c_name"), 12).alias("shard"))


_PINS = """pins AS (SELECT o_orderkey AS id, o_custkey AS root, CASE WHEN o_orderstatus = 'F' THEN 'gone' ELSE 'active' END AS status,
  CASE WHEN o_orderkey % 3 > 0 THEN CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS expires_at, CASE WHEN o_orderkey % 2 = 0 THEN 'protect' ELSE 'release' END AS kind FROM orders)"""
_NOW = 900_000_000


def _pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("root"), F.when(F.col("o_orderstatus") == "F", "gone").otherwise("active").alias("status"), F.when(k % 3 > 0, seconds("o_orderdate")).alias("expires_at"), F.when(k % 2 == 0, "protect").otherwise("release").alias("kind"))


@query(f"WITH {_PINS} SELECT id, root FROM pins WHERE status = 'active' AND (expires_at IS NULL OR expires_at > {_NOW})")
def active_pins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalogue.active(_pins(spark, sf_dir), _NOW).select("id", "root")


@query(f"""WITH {_PINS}, a AS (SELECT * FROM pins WHERE status = 'active' AND (expires_at IS NULL OR expires_at > {_NOW}))
SELECT root FROM a WHERE id % 3 < 2 UNION SELECT root FROM pins WHERE kind = 'protect' AND id % 3 = 2""")
def protected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pins(spark, sf_dir)
    return catalogue.roots(p.filter("id % 3 = 0"), p.filter("id % 3 = 1"), p.filter("id % 3 = 2").withColumn("status", F.lit("pending")), _NOW)


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem) l WHERE (l_orderkey, l_linenumber, l_partkey) > (1200, 3, 50) ORDER BY ALL LIMIT 60")
def list_parts_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_partkey"]
    return catalogue.keyset_page(table(spark, sf_dir, "lineitem").select(*cols).distinct(), cols, (1200, 3, 50), 60)


_ASSIGNED = "SELECT 'g' || CAST(user_id % 5 AS VARCHAR) AS \"group\", event_type AS topic, user_id % 9 AS part, 'm' || CAST(user_id % 7 AS VARCHAR) AS member FROM events"


@query(f'WITH a AS ({_ASSIGNED}) SELECT "group", topic, part, count(DISTINCT member) AS owners FROM a GROUP BY ALL HAVING count(DISTINCT member) > 1')
def assignment_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("g"), (u % 5).cast("string")).alias("group"), F.col("event_type").alias("topic"), (u % 9).alias("part"), F.concat(F.lit("m"), (u % 7).cast("string")).alias("member"))
    return catalogue.duplicate_ownership(rows)


@query("SELECT * FROM (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2) c) x WHERE previous >= text")
def mutation_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    return catalogue.unsorted(rows, "conv_id", "turn", "text")


_PAGES = "pages_ AS (SELECT l_orderkey AS db, l_linenumber AS page FROM lineitem), n AS (SELECT o_orderkey AS db, o_orderkey % 7 + 1 AS expected FROM orders)"


@query(f"""WITH {_PAGES}, g AS (SELECT db, count(DISTINCT page) AS pages, min(page) AS low, max(page) AS high FROM pages_ GROUP BY db)
SELECT n.db, coalesce(pages, 0) AS pages, expected FROM n LEFT JOIN g ON g.db = n.db WHERE NOT coalesce(pages = expected AND low = 1 AND high = expected, false)""")
def page_table_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("db"), F.col("l_linenumber").alias("page"))
    return catalogue.incomplete(pages, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("db"), (F.col("o_orderkey") % 7 + 1).alias("expected")))


@query("SELECT l_orderkey AS db, l_linenumber AS page, l_partkey FROM lineitem WHERE l_linenumber <= l_orderkey % 4 + 1")
def page_table_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("db"), F.col("l_linenumber").alias("page"), "l_partkey")
    return catalogue.truncate(pages, F.col("db") % 4 + 1)


@query(f"""WITH {CHANGES_SQL}, h AS (SELECT key, arg_max(cid, revision) AS version, arg_max(op, revision) = 'delete' AS tombstone FROM changes WHERE revision <= {REVISION_AT(4)} GROUP BY key),
p AS (SELECT key, arg_min(cid, revision) AS version, arg_min(revision, revision) % 2 = 0 AS if_none, arg_min(op, revision) = 'delete' AS tombstone FROM changes WHERE revision > {REVISION_AT(4)} GROUP BY key)
SELECT p.key, p.version, h.version AS previous, p.tombstone, NOT (if_none AND h.version IS NOT NULL AND NOT h.tombstone) AND NOT (p.tombstone AND NOT coalesce(h.version IS NOT NULL AND NOT h.tombstone, false)) AS accepted
FROM p LEFT JOIN h ON h.key = p.key""")
def bucket_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    half = revision_at(rows, 4)
    head = rows.filter(F.col("revision") <= half).groupBy("key").agg(F.max_by("cid", "revision").alias("version"), (F.max_by("op", "revision") == "delete").alias("tombstone"))
    puts = rows.filter(F.col("revision") > half).groupBy("key").agg(F.min_by("cid", "revision").alias("version"), (F.min("revision") % 2 == 0).alias("if_none"), (F.min_by("op", "revision") == "delete").alias("tombstone"))
    return catalogue.put_versions(head, puts)


@query("""WITH RECURSIVE q AS (SELECT source AS namespace, doc_id AS key, CAST(octet_length(encode(text)) AS BIGINT) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i FROM documents),
f AS (SELECT namespace, key, i, CAST(0 AS BIGINT) AS extent, CAST(0 AS BIGINT) AS pos, size FROM q WHERE i = 1
  UNION ALL SELECT q.namespace, q.key, q.i, CASE WHEN f.pos + f.size > 0 AND f.pos + f.size + q.size > 65536 THEN f.extent + 1 ELSE f.extent END,
    CASE WHEN f.pos + f.size + q.size > 65536 THEN 0 ELSE f.pos + f.size END, q.size FROM f JOIN q ON q.namespace = f.namespace AND q.i = f.i + 1)
SELECT namespace, key, extent, pos AS "offset", size FROM f""")
def small_object_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("source").alias("namespace"), F.col("doc_id").alias("key"), F.octet_length("text").cast("bigint").alias("size"))
    return catalogue.pack(d, 65_536)


@query(f"""WITH RECURSIVE {RECORDS_SQL}, {BATCHES_SQL},
w AS (SELECT r, p AS pos, (p + r) % 4 AS part, 40 * r AS "offset", 500 + 700 * r AS max_bytes FROM range(6) a(r), range(4) b(p)),
c AS (SELECT r, pos, w.part, batch, bytes, max_bytes, row_number() OVER (PARTITION BY r ORDER BY pos, batch) AS i, row_number() OVER (PARTITION BY r, pos ORDER BY batch) = 1 AS fresh
      FROM w JOIN batches b ON b.part = w.part AND last_offset >= "offset"),
f AS (SELECT r, i, part, batch, true AS taken, greatest(max_bytes - bytes, 0) AS left_ FROM c WHERE i = 1
      UNION ALL SELECT c.r, c.i, c.part, c.batch, c.fresh OR (f.taken AND c.bytes <= f.left_),
        CASE WHEN c.fresh OR (f.taken AND c.bytes <= f.left_) THEN greatest(f.left_ - c.bytes, 0) ELSE f.left_ END FROM f JOIN c ON c.r = f.r AND c.i = f.i + 1)
SELECT r AS request, part, batch FROM f WHERE taken""")
def log_fetch_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, p = F.col("request"), F.col("pos")
    wanted = spark.range(6).select(F.col("id").alias("request"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))).alias("pos")).select("request", "pos", ((p + r) % 4).alias("part"), (r * 40).alias("offset"), (r * 700 + 500).alias("max_bytes"))
    return catalogue.fetch_request(wanted, log_batches(log_records(spark, sf_dir)))


@query(f"""WITH {RECORDS_SQL} SELECT part, "offset" // 256 AS segment, md5(string_agg(key, '|' ORDER BY "offset")) AS image_md5, count(*) AS records FROM records GROUP BY 1, 2""")
def segment_image(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("offset", "key")))
    joined = F.array_join(F.transform(ordered, lambda x: x["key"]), "|")
    return log_records(spark, sf_dir).groupBy("part", F.floor(F.col("offset") / 256).alias("segment")).agg(F.md5(joined).alias("image_md5"), F.count(F.lit(1)).alias("records"))


@query(f"WITH {RECORDS_SQL} SELECT part, max(\"offset\") AS last_kept, count(*) AS kept FROM records JOIN (SELECT part AS p, (max(\"offset\") + 1) * 2 // 3 AS committed FROM records GROUP BY part) c ON p = part WHERE \"offset\" < committed GROUP BY part")
def log_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    committed = records.groupBy("part").agg(F.floor((F.max("offset") + 1) * 2 / 3).alias("committed"))
    kept = records.join(committed, "part").filter(F.col("offset") < F.col("committed"))
    return kept.groupBy("part").agg(F.max("offset").alias("last_kept"), F.count(F.lit(1)).alias("kept"))


@query("SELECT user_id % 16 AS namespace, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'view') AS \"view\" FROM events GROUP BY 1")
def op_cost_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 16).alias("namespace"), "event_type", F.lit(1).alias("one"))
    matrix = catalogue.cost_matrix(e, "namespace", "event_type", "one", ["click", "error", "view"])
    return matrix.select("namespace", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "error", "view")])


@query("""WITH u AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '' WHEN 1 THEN '?mode=ro&snapshot=' || page_id WHEN 2 THEN '?mode=rw&mode=ro' WHEN 3 THEN '?busy_timeout_ms=' || page_id WHEN 4 THEN '?color=red'
    WHEN 5 THEN '?mode=rw&busy_timeout_ms=9&snapshot=s' || page_id WHEN 6 THEN '?snapshot=' ELSE '?' END AS q, page_id % 11 = 5 AS other, page_id % 13 = 7 AS bare, split_part(split_part(url, '://', 2), '/', 1) AS host FROM pages)
SELECT page_id, CASE WHEN sound THEN host END AS database, CASE WHEN sound AND k = 1 THEN 'ro' WHEN sound AND k = 5 THEN 'rw' END AS mode,
  CASE WHEN sound AND k = 1 THEN CAST(page_id AS VARCHAR) WHEN sound AND k = 5 THEN 's' || page_id END AS snapshot, CASE WHEN sound AND k = 3 THEN CAST(page_id AS VARCHAR) WHEN sound AND k = 5 THEN '9' END AS busy_timeout_ms
FROM (SELECT *, page_id % 8 AS k, page_id % 8 NOT IN (2, 4) AND NOT other AND NOT bare AND host <> '' AS sound FROM u) v""")
def uri_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, own = F.col("page_id"), F.col("page_id").cast("string")
    host = F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    forms = [F.lit(""), F.concat(F.lit("?mode=ro&snapshot="), own), F.lit("?mode=rw&mode=ro"), F.concat(F.lit("?busy_timeout_ms="), own), F.lit("?color=red"), F.concat(F.lit("?mode=rw&busy_timeout_ms=9&snapshot=s"), own), F.lit("?snapshot="), F.lit("?")]
    uri = F.concat(F.when(i % 11 == 5, "file:").otherwise("tessera:"), F.when(i % 13 == 7, "").otherwise(host), F.element_at(F.array(*forms), (i % 8 + 1).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", catalogue.parse_uri(uri).alias("p")).select("page_id", "p.*")


@query("SELECT source AS location, count(*) AS inputs, CAST(sum(length(text)) AS BIGINT) AS characters FROM documents GROUP BY source")
def compute_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"location": b["source"], "characters": b["text"].str.len()})

    done = catalogue.run_job(table(spark, sf_dir, "documents").select("source", "text"), measure, "location string, characters bigint")
    return done.groupBy("location").agg(F.count(F.lit(1)).alias("inputs"), F.sum("characters").alias("characters"))


@query(f"WITH {CHANGES_SQL}, {_live()} SELECT * FROM live")
def checkpoint_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "states")
    kv.snapshot(changes(spark, sf_dir)).write.parquet(path)
    return spark.read.parquet(path)


@query(f"""WITH {CHANGES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY revision DESC) AS rn FROM changes) SELECT namespace, revision, value_kind FROM r WHERE rn <= 12""")
def audit_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir).withColumn("request_id", F.col("cid"))
    return versions.newest_records(rows, 12).select("namespace", "revision", "value_kind")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def empty_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    open_ = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(open_, "c_custkey", "left_anti")


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 AND substr(sha256(text), 1, 1) >= '8' THEN 412 WHEN doc_id % 3 = 1 AND substr(sha256(text), 1, 1) < '8' THEN 304 ELSE 200 END AS status FROM documents""")
def conditional_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("etag"))
    known = F.when(F.substring("etag", 1, 1) < "8", F.concat(F.lit('"x", "'), F.col("etag"), F.lit('"'))).otherwise(F.lit('"x"'))
    status = text.etag_passes(F.col("etag"), F.when(F.col("doc_id") % 3 == 0, known), F.when(F.col("doc_id") % 3 == 1, known))
    return d.select("doc_id", status.alias("status"))


@query("SELECT s_nationkey, count(*) AS queued FROM supplier WHERE s_suppkey % 3 <> 1 GROUP BY s_nationkey")
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("status", F.element_at(F.array(F.lit("queued"), F.lit("done"), F.lit("delegated")), (F.col("s_suppkey") % 3 + 1).cast("int")))
    return s.filter("status in ('queued', 'delegated')").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("queued"))


@query("SELECT doc_id, md5(substr(text, CAST(doc_id * 37 % (length(text) + 1) AS INTEGER) + 1, 40)) AS slice_md5 FROM documents")
def vectored_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    asked = d.select(F.col("doc_id").alias("output_index"), F.col("doc_id").alias("pack"), (F.col("doc_id") * 37 % (F.length("text") + 1)).cast("int").alias("offset"), F.lit(40).alias("length"), F.lit("").alias("digest"))
    cut = objects.read_slices(asked, d.select(F.col("doc_id").alias("pack"), F.col("text").alias("content")))
    return cut.select(F.col("output_index").alias("doc_id"), F.md5("payload").alias("slice_md5"))


@query(f"""WITH {RECORDS_SQL}, {BATCHES_SQL} SELECT part, count(*) AS batches, CAST(sum(records) AS BIGINT) AS records, max(last_offset) - min(base_offset) + 1 AS span, max(max_ts) AS max_ts FROM batches GROUP BY part""")
def record_set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = log_batches(log_records(spark, sf_dir))
    return b.groupBy("part").agg(F.count(F.lit(1)).alias("batches"), F.sum("records").alias("records"), (F.max("last_offset") - F.min("base_offset") + 1).alias("span"), F.max("max_ts").alias("max_ts"))


@query(f"""WITH {CHANGES_SQL} SELECT value_kind, count(*) AS commands, CAST(sum(length(cid) + length(key)) AS BIGINT) AS encoded_bytes, count(DISTINCT namespace) AS namespaces FROM changes GROUP BY value_kind""")
def command_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy("value_kind").agg(F.count(F.lit(1)).alias("commands"), F.sum(F.length("cid") + F.length("key")).alias("encoded_bytes"), F.count_distinct("namespace").alias("namespaces"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS newest FROM orders QUALIFY newest <= 3")
def newest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", rank.alias("newest")).filter("newest <= 3").withColumn("newest", F.col("newest").cast("bigint"))


@query(f"""WITH {RECORDS_SQL} SELECT part, producer, count(*) FILTER ("offset" < 700) AS hot, count(*) FILTER ("offset" >= 700) AS cold FROM records GROUP BY part, producer""")
def tiered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = log_records(spark, sf_dir)
    hot, cold = records.filter("offset < 700").withColumn("tier", F.lit("hot")), records.filter("offset >= 700").withColumn("tier", F.lit("cold"))
    return hot.unionByName(cold).groupBy("part", "producer").agg(F.count_if(F.col("tier") == "hot").alias("hot"), F.count_if(F.col("tier") == "cold").alias("cold"))


@query("SELECT 'g' || CAST(user_id % 20 AS VARCHAR) AS \"group\", count(DISTINCT user_id) AS members, min('m' || CAST(user_id AS VARCHAR)) AS leader FROM events GROUP BY 1")
def group_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "events").select(F.concat(F.lit("g"), (F.col("user_id") % 20).cast("string")).alias("group"), F.concat(F.lit("m"), F.col("user_id").cast("string")).alias("member"), F.lit(0).cast("bigint").alias("last_seen"), F.lit(9).cast("bigint").alias("session_timeout")).distinct()
    return log.alive_members(m, 5).groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.first("leader").alias("leader"))
