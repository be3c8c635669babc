"""Queries over versioned keyed data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import kv, versions
from ..sources.tables import CHANGES_SQL, REVISION_AT, changes, revision_at
from .registry import query


def _live(at: str = "", name: str = "live", source: str = "changes") -> str:
    """The SQL of a snapshot: puts after each key's last delete, the last of them and their number."""
    where = f"WHERE revision <= {at}" if at else ""
    return f"""{name} AS (
  SELECT key, arg_max(cid, revision) AS cid, arg_max(value_kind, revision) AS value_kind,
         count(*) AS generation, max(revision) AS revision
  FROM (SELECT *, coalesce(max(CASE WHEN op = 'delete' THEN revision END) OVER (PARTITION BY key), 0) AS gone
        FROM {source} {where}) x
  WHERE op = 'put' AND revision > gone GROUP BY key)"""


@query(f"WITH {CHANGES_SQL}, {_live()} SELECT * FROM live")
def kv_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.snapshot(changes(spark, sf_dir))


@query(f"WITH {CHANGES_SQL}, {_live(REVISION_AT(4))} SELECT * FROM live")
def kv_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return kv.snapshot(rows, revision_at(rows, 4))


@query(f"WITH {CHANGES_SQL}, {_live()} SELECT * FROM live WHERE key = '0000000007'")
def kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get(kv.snapshot(changes(spark, sf_dir)), "0000000007")


ASKED = ["0000000007", "missing", "0000000003", "0000000007", "0000000012"]


@query(f"""WITH {CHANGES_SQL}, {_live()},
asked(pos, key) AS (VALUES {', '.join(f"({i}, '{k}')" for i, k in enumerate(ASKED))})
SELECT pos, asked.key, cid, value_kind, generation, revision FROM asked LEFT JOIN live ON live.key = asked.key""")
def kv_bulk_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.get_many(kv.snapshot(changes(spark, sf_dir)), ASKED)


@query(f"""WITH {CHANGES_SQL}, {_live()},
m AS (SELECT * FROM live WHERE key >= '0000000003' AND key < '0000000090' AND key LIKE '00000000%' AND key > '0000000004' ORDER BY key LIMIT 21)
SELECT *, (SELECT count(*) FROM m) > 20 AS has_more FROM (SELECT * FROM m ORDER BY key LIMIT 20) p""")
def kv_scan_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kv.scan(kv.snapshot(changes(spark, sf_dir)), start="0000000003", end="0000000090", prefix="00000000", after="0000000004", limit=20)


@query(f"""WITH {CHANGES_SQL}, {_live(REVISION_AT(5))},
m AS (SELECT * FROM live WHERE key LIKE '000000001%' ORDER BY key LIMIT 6)
SELECT *, (SELECT count(*) FROM m) > 5 AS has_more FROM (SELECT * FROM m ORDER BY key LIMIT 5) p""")
def kv_scan_at_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return kv.scan(kv.snapshot(rows, revision_at(rows, 5)), prefix="000000001", limit=5)


@query(f"""WITH {CHANGES_SQL}, {_live()},
pending AS (SELECT key, op, cid, value_kind FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY revision) AS rn FROM changes WHERE revision % 5 = 0) x WHERE rn = 1)
SELECT coalesce(live.key, p.key) AS key, coalesce(p.cid, live.cid) AS cid, coalesce(p.value_kind, live.value_kind) AS value_kind, p.op IS NOT NULL AS pending
FROM live FULL JOIN pending p ON p.key = live.key WHERE p.op IS NULL OR p.op = 'put'""")
def kv_read_your_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    first = rows.filter("revision % 5 = 0").groupBy("key").agg(F.min_by(F.struct("op", "cid", "value_kind"), "revision").alias("v")).select("key", "v.*")
    return kv.read_your_writes(kv.snapshot(rows), first)


@query(f"""WITH {CHANGES_SQL} SELECT key, revision, op, cid, value_kind, committed_at,
  lag(revision) OVER (PARTITION BY key ORDER BY revision) AS previous_revision FROM changes""")
def kv_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    previous = F.lag("revision").over(Window.partitionBy("key").orderBy("revision"))
    return changes(spark, sf_dir).select("key", "revision", "op", "cid", "value_kind", "committed_at", previous.alias("previous_revision"))


_DIFF = """SELECT coalesce(a.key, b.key) AS key,
  CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'modified' END AS change"""


@query(f"""WITH {CHANGES_SQL}, {_live(REVISION_AT(3), 'a')}, {_live(REVISION_AT(7), 'b')}
{_DIFF} FROM a FULL JOIN b ON a.key = b.key
WHERE a.key IS NULL OR b.key IS NULL OR a.cid <> b.cid OR a.value_kind <> b.value_kind OR a.generation <> b.generation
ORDER BY 1 LIMIT 10000""")
def ns_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return versions.diff(kv.snapshot(rows, revision_at(rows, 3)), kv.snapshot(rows, revision_at(rows, 7)))


@query(f"""WITH {CHANGES_SQL}, {_live('', 'a')}, {_live(REVISION_AT(4), 'b')}
SELECT coalesce(a.key, b.key) AS key, CASE WHEN b.key IS NULL THEN 'delete' ELSE 'put' END AS op, b.cid, b.value_kind,
       CASE WHEN b.key IS NOT NULL THEN coalesce(a.generation, 0) + 1 END AS generation
FROM a FULL JOIN b ON a.key = b.key
WHERE a.key IS NULL OR b.key IS NULL OR a.cid <> b.cid OR a.value_kind <> b.value_kind""")
def rollback_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return versions.rollback(kv.snapshot(rows), kv.snapshot(rows, revision_at(rows, 4)))


@query(f"""WITH {CHANGES_SQL}, {_live(REVISION_AT(6), 'head')},
mut AS (SELECT revision // 3 AS txn, key, CASE revision % 4 WHEN 0 THEN 'assert' WHEN 1 THEN 'delete' ELSE 'put' END AS op, cid,
               CASE revision % 3 WHEN 0 THEN 'match' WHEN 1 THEN 'any' ELSE 'absent' END AS pre,
               revision % 5 + 1 AS pre_generation, cid AS pre_cid FROM changes WHERE revision > {REVISION_AT(6)}),
c AS (SELECT mut.*, head.generation AS cur_generation,
             CASE pre WHEN 'absent' THEN head.generation IS NULL
                      WHEN 'match' THEN head.generation IS NOT DISTINCT FROM pre_generation AND head.cid IS NOT DISTINCT FROM pre_cid
                      ELSE true END AS holds
      FROM mut LEFT JOIN head ON head.key = mut.key),
v AS (SELECT txn, bool_and(holds) AND bool_or(op <> 'assert') AS applied FROM c GROUP BY txn)
SELECT c.*, applied, CASE WHEN applied AND op = 'put' THEN coalesce(cur_generation, 0) + 1 END AS new_generation
FROM c JOIN v USING (txn)""")
def txn_preconditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    r, at = F.col("revision"), revision_at(rows, 6)
    mutations = rows.filter(r > at).select(
        F.floor(r / 3).alias("txn"), "key", F.when(r % 4 == 0, "assert").when(r % 4 == 1, "delete").otherwise("put").alias("op"), "cid",
        F.when(r % 3 == 0, "match").when(r % 3 == 1, "any").otherwise("absent").alias("pre"), (r % 5 + 1).alias("pre_generation"), F.col("cid").alias("pre_cid"))
    return versions.apply_transactions(kv.snapshot(rows, at), mutations)


_COMMITS = "commits AS (SELECT namespace, revision, committed_at - revision % 7 * 3600 AS client_ts FROM changes)"


@query(f"""WITH {CHANGES_SQL}, {_COMMITS} SELECT *, max(client_ts) OVER (PARTITION BY namespace ORDER BY revision ROWS UNBOUNDED PRECEDING) AS committed_ts FROM commits""")
def commit_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return versions.commit_times(changes(spark, sf_dir).select("namespace", "revision", (F.col("committed_at") - F.col("revision") % 7 * 3600).alias("client_ts")))


def _retained(name: str, keep: int, age: int, named: str = "false") -> str:
    return f"""{name} AS (SELECT namespace, revision, committed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY revision DESC) AS rn, max(committed_at) OVER (PARTITION BY namespace) AS newest
  FROM changes) x WHERE rn <= {keep} OR committed_at >= newest - {age} OR {named})"""


@query(f"WITH {CHANGES_SQL}, {_retained('kept', 20, 90_000, 'revision % 97 = 0')} SELECT * FROM kept")
def retention_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return versions.retained(rows, 20, 90_000, rows.filter("revision % 97 = 0"))


@query(f"""WITH {CHANGES_SQL}, {_retained('before', 20, 90_000)}, {_retained('after', 5, 200_000)}
SELECT namespace, revision, 'protect' AS intent FROM (SELECT namespace, revision FROM after EXCEPT SELECT namespace, revision FROM before) p
UNION ALL SELECT namespace, revision, 'release' FROM (SELECT namespace, revision FROM before EXCEPT SELECT namespace, revision FROM after) r""")
def retention_pin_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = changes(spark, sf_dir)
    return versions.pin_intents(versions.retained(rows, 20, 90_000), versions.retained(rows, 5, 200_000))


_REQUESTS = "SELECT 'r' || CAST(revision % 800 AS VARCHAR) AS request_id, md5(value_kind) AS fingerprint, revision, namespace FROM changes"


@query(f"""WITH {CHANGES_SQL}, q AS ({_REQUESTS}), k AS (SELECT request_id, arg_min(fingerprint, revision) AS known FROM q WHERE revision <= 600 GROUP BY 1)
SELECT q.request_id, q.revision, CASE WHEN known IS NULL THEN 'new' WHEN known = fingerprint THEN 'replay' ELSE 'conflict' END AS outcome
FROM q LEFT JOIN k USING (request_id) WHERE q.revision > 600""")
def idempotency_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = changes(spark, sf_dir).select(F.concat(F.lit("r"), (F.col("revision") % 800).cast("string")).alias("request_id"), F.md5("value_kind").alias("fingerprint"), "revision")
    known = requests.filter("revision <= 600").groupBy("request_id").agg(F.min_by("fingerprint", "revision").alias("fingerprint"))
    return versions.idempotent(requests.filter("revision > 600"), known).select("request_id", "revision", "outcome")


@query(f"""WITH {CHANGES_SQL}, q AS ({_REQUESTS}) SELECT namespace, revision, request_id FROM (
  SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY revision DESC, request_id DESC) AS rn FROM q) x WHERE rn <= 25""")
def idempotency_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    requests = changes(spark, sf_dir).select("namespace", "revision", F.concat(F.lit("r"), (F.col("revision") % 800).cast("string")).alias("request_id"))
    return versions.newest_records(requests, 25)


@query("""WITH wanted AS (SELECT 'snap' || CAST(c_custkey % 40 AS VARCHAR) || '-' || CAST(c_custkey AS VARCHAR) AS name,
   CASE WHEN c_custkey % 3 > 0 THEN c_custkey * 9 END AS revision FROM customer),
taken AS (SELECT DISTINCT name FROM wanted WHERE revision % 5 = 0)
SELECT w.name, coalesce(revision, 1000) AS revision, t.name IS NULL AND coalesce(revision, 1000) <= 1000 AS accepted
FROM wanted w LEFT JOIN taken t ON t.name = w.name""")
def snapshot_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    wanted = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("snap"), (k % 40).cast("string"), F.lit("-"), k.cast("string")).alias("name"), F.when(k % 3 > 0, k * 9).alias("revision"))
    return versions.create_named(wanted.filter("revision % 5 = 0"), wanted, 1000)


@query(f"""WITH {CHANGES_SQL} SELECT namespace, max(revision) AS head_revision, arg_max(cid, revision) AS head_cid, count(*) AS commits,
  count(DISTINCT key) AS keys FROM changes GROUP BY namespace""")
def namespace_inspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes(spark, sf_dir).groupBy("namespace").agg(F.max("revision").alias("head_revision"), F.max_by("cid", "revision").alias("head_cid"), F.count(F.lit(1)).alias("commits"), F.count_distinct("key").alias("keys"))
