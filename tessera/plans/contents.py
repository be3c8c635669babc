"""Queries over content-addressed objects, listings and file trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import objects, trees
from ..sources.tables import PATHS_SQL, paths, table
from .registry import query

CHUNK = 256
_OBJECTS = "objects AS (SELECT doc_id AS object, text AS content FROM documents)"
_CHUNKS = f"""{_OBJECTS}, chunks AS (SELECT object, o AS "offset", length(substr(content, o + 1, {CHUNK})) AS size, sha256(substr(content, o + 1, {CHUNK})) AS digest,
  substr(content, o + 1, {CHUNK}) AS payload FROM (SELECT object, content, unnest(range(0, greatest(length(content), 1), {CHUNK})) AS o FROM objects WHERE length(content) > 0) x)"""


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("object"), F.col("text").alias("content"))


@query(f'WITH {_CHUNKS} SELECT object, "offset", size, digest FROM chunks')
def object_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.chunks(_objects(spark, sf_dir), CHUNK).drop("payload")


@query(f"WITH {_OBJECTS} SELECT object, md5(content) AS body_md5, length(content) AS size FROM objects WHERE length(content) > 0")
def object_assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = objects.assemble(objects.chunks(_objects(spark, sf_dir), CHUNK))
    return whole.select("object", F.md5("content").alias("body_md5"), F.length("content").cast("bigint").alias("size"))


@query(f'WITH {_OBJECTS} SELECT object, substr(content, 301, 400) AS body FROM objects WHERE length(content) > 300')
def object_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.range_body(objects.chunks(_objects(spark, sf_dir), CHUNK), F.lit(300), F.lit(699))


@query(f"""WITH {_CHUNKS} SELECT object, "offset", greatest(300 - "offset", 0) AS from_, least(699 - "offset" + 1, size) AS until
FROM chunks WHERE "offset" <= 699 AND "offset" + size > 300""")
def object_range_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.range_chunks(objects.chunks(_objects(spark, sf_dir), CHUNK), F.lit(300), F.lit(699)).select("object", "offset", "from_", "until")


@query("""WITH b AS (SELECT doc_id AS id, sha256(text) AS digest FROM documents), s AS (SELECT DISTINCT digest FROM b WHERE id % 3 = 0)
SELECT b.digest, min(id) AS id, count(*) AS copies, any_value(s.digest) IS NOT NULL AS already_existed
FROM b LEFT JOIN s ON s.digest = b.digest WHERE id % 3 <> 0 GROUP BY b.digest""")
def block_put(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))
    return objects.put_blocks(blocks.filter("id % 3 <> 0"), blocks.filter("id % 3 = 0"))


@query(f"""WITH {_CHUNKS}, bad AS (SELECT object, CASE WHEN object % 11 = 3 AND "offset" = 256 THEN 250 ELSE "offset" END AS "offset", size FROM chunks WHERE NOT (object % 13 = 5 AND "offset" = 512)),
e AS (SELECT *, coalesce(lag("offset" + size) OVER (PARTITION BY object ORDER BY "offset"), 0) AS expected FROM bad),
g AS (SELECT object, count(*) FILTER ("offset" <> expected OR size <= 0) AS bad_chunks, max("offset" + size) AS e FROM e GROUP BY object)
SELECT g.object, bad_chunks, e <> length(content) AS wrong_size FROM g JOIN objects USING (object) WHERE bad_chunks > 0 OR e <> length(content)""")
def manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _objects(spark, sf_dir)
    parts = objects.chunks(rows, CHUNK).select("object", "offset", "size").filter(~((F.col("object") % 13 == 5) & (F.col("offset") == 512)))
    parts = parts.withColumn("offset", F.when((F.col("object") % 11 == 3) & (F.col("offset") == 256), 250).otherwise(F.col("offset")))
    return objects.manifest_faults(parts, rows.select("object", F.length("content").alias("total")))


@query("SELECT doc_id FROM documents WHERE doc_id % 17 = 4")
def corruption_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    payload = F.when(F.col("doc_id") % 17 == 4, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    return objects.corrupt(d.select("doc_id", F.sha2("text", 256).alias("digest"), payload.alias("payload"))).select("doc_id")


@query("""SELECT digest, size, CASE WHEN id % 7 = 1 THEN 'corrupt' WHEN id % 5 = 2 THEN 'missing' ELSE 'healthy' END AS integrity_state
FROM (SELECT sha256(text) AS digest, any_value(length(text)) AS size, min(doc_id) AS id FROM documents GROUP BY 1) b WHERE digest > '4' ORDER BY digest LIMIT 50""")
def block_inventory_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.max(F.length("text").cast("bigint")).alias("size"), F.min("doc_id").alias("id"))
    return objects.block_page(d.withColumns({"corrupt": F.col("id") % 7 == 1, "present": F.col("id") % 5 != 2}), "4", 50)


@query("SELECT source AS location, count(*) AS blocks, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def storage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(F.col("source").alias("location")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.octet_length("text")).alias("bytes"))


_KEYS = f"{PATHS_SQL}, keys AS (SELECT path AS key, max(size) AS size, min(page_id) % 6 = 1 AS tombstone FROM paths GROUP BY path)"


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths(spark, sf_dir).groupBy(F.col("path").alias("key")).agg(F.max("size").alias("size"), (F.min("page_id") % 6 == 1).alias("tombstone"))


def _listing(prefix: str, after: str, limit: int) -> str:
    n = len(prefix)
    return f"""WITH {_KEYS}, l AS (SELECT *, CASE WHEN strpos(substr(key, {n + 1}), '/') > 0 THEN substr(key, 1, {n} + strpos(substr(key, {n + 1}), '/')) END AS rolled
  FROM keys WHERE NOT tombstone AND starts_with(key, '{prefix}') AND key > '{after}'),
p AS (SELECT coalesce(rolled, key) AS entry, rolled IS NOT NULL AS is_prefix, max(CASE WHEN rolled IS NULL THEN size END) AS size
      FROM l GROUP BY 1, 2 HAVING coalesce(rolled, key) > '{after}' ORDER BY 1 LIMIT {limit})
SELECT *, (SELECT count(*) FROM p) >= {limit} AS truncated FROM p"""


@query(_listing("", "a", 12))
def s3_list_delimiter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.list_objects(_keys(spark, sf_dir), "", "/", "a", 12)


@query(_listing("th", "thb", 1000))
def s3_list_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.list_objects(_keys(spark, sf_dir), "th", "/", "thb")


@query(f"WITH {_KEYS} SELECT * FROM (SELECT * FROM keys WHERE starts_with(key, 'th') ORDER BY key LIMIT 30) p WHERE NOT tombstone")
def bucket_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.bucket_page(_keys(spark, sf_dir), "th", 30)


_RANGES = "parts AS (SELECT i AS partition_id, i * 4096 AS hash_start, (i + 1) * 4096 AS hash_end FROM range(16) r(i))"


def _ranges(spark: SparkSession) -> DataFrame:
    return spark.range(16).select(F.col("id").alias("partition_id"), (F.col("id") * 4096).alias("hash_start"), ((F.col("id") + 1) * 4096).alias("hash_end"))


@query(f"""WITH {_KEYS}, {_RANGES}, k AS (SELECT key, CAST('0x' || substr(sha256(key), 1, 4) AS BIGINT) AS point FROM keys)
SELECT key, point, partition_id FROM k JOIN parts ON point >= hash_start AND point < hash_end""")
def partition_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objects.route(_keys(spark, sf_dir).select("key"), _ranges(spark)).select("key", "point", "partition_id")


@query(f"""WITH {_RANGES}, m AS (SELECT partition_id, CASE WHEN partition_id = 7 THEN hash_start + 5 ELSE hash_start END AS hash_start, hash_end FROM parts WHERE partition_id <> 15),
c AS (SELECT *, coalesce(lag(hash_end) OVER (ORDER BY hash_start), 0) AS prev, lead(hash_start) OVER (ORDER BY hash_start) AS nxt FROM m)
SELECT partition_id, hash_start, hash_end FROM c WHERE hash_start <> prev OR hash_end <= hash_start OR (nxt IS NULL AND hash_end <> 65536)""")
def partition_map_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = _ranges(spark).filter("partition_id <> 15").withColumn("hash_start", F.when(F.col("partition_id") == 7, F.col("hash_start") + 5).otherwise(F.col("hash_start")))
    return objects.partition_faults(moved)


_UPLOADS = """stored AS (SELECT l_orderkey AS upload, l_linenumber AS part, md5(CAST(l_partkey AS VARCHAR)) AS etag, CAST(l_quantity AS BIGINT) AS size
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS rn FROM lineitem) x WHERE rn = 1),
asked AS (SELECT upload, row_number() OVER (PARTITION BY upload ORDER BY CASE WHEN upload % 19 = 0 THEN -part ELSE part END) AS pos, part,
          CASE WHEN upload % 23 = 0 AND part = 1 THEN 'x' ELSE etag END AS etag FROM stored)"""


@query(f"""WITH {_UPLOADS}, j AS (SELECT a.*, s.size, s.etag AS stored_etag, coalesce(lag(a.part) OVER w < a.part, true) AS ascending, lead(a.part) OVER w IS NULL AS is_last
  FROM asked a LEFT JOIN stored s ON s.upload = a.upload AND s.part = a.part WINDOW w AS (PARTITION BY a.upload ORDER BY pos)),
g AS (SELECT upload, count(*) AS parts, sum(size) AS size, bool_and(ascending) AS asc_, bool_and(coalesce(stored_etag = etag, false)) AS found, bool_and(is_last OR size >= 4) AS long_ FROM j GROUP BY upload),
r AS (SELECT *, CASE WHEN NOT asc_ THEN 'order' WHEN NOT found THEN 'part' WHEN NOT long_ THEN 'size' END AS reason FROM g)
SELECT upload, reason IS NULL AS accepted, parts, CAST(CASE WHEN reason IS NULL THEN size END AS BIGINT) AS size, reason FROM r""")
def multipart_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")).alias("v")
    stored = lines.groupBy(F.col("l_orderkey").alias("upload"), F.col("l_linenumber").alias("part")).agg(first).select("upload", "part", F.md5(F.col("v.l_partkey").cast("string")).alias("etag"), F.col("v.l_quantity").cast("bigint").alias("size"))
    asked = stored.select("upload", "part", F.when(F.col("upload") % 19 == 0, -F.col("part")).otherwise(F.col("part")).alias("pos"), F.when((F.col("upload") % 23 == 0) & (F.col("part") == 1), "x").otherwise(F.col("etag")).alias("etag"))
    return objects.complete_upload(asked, stored, 4)


@query("""WITH d AS (SELECT doc_id, text, doc_id // 8 AS pack, length(text) AS length, coalesce(sum(length(text)) OVER (PARTITION BY doc_id // 8 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM documents)
SELECT doc_id AS output_index, md5(text) AS payload_md5, true AS intact FROM d""")
def pack_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.floor(F.col("doc_id") / 8).alias("pack"))
    joined = d.groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("m"))
    packs = joined.select("pack", F.array_join(F.transform("m", lambda x: x["text"]), "").alias("content"))
    start = F.aggregate(F.slice("m", 1, F.col("i")), F.lit(0), lambda acc, x: acc + F.length(x["text"]))
    slices = joined.select("pack", "m", F.posexplode("m").alias("i", "e")).select(F.col("e.doc_id").alias("output_index"), "pack", start.alias("offset"), F.length("e.text").alias("length"), F.sha2("e.text", 256).alias("digest"))
    return objects.read_slices(slices, packs).select("output_index", F.md5("payload").alias("payload_md5"), "intact")


@query("""SELECT CAST(l_suppkey AS BIGINT) AS extent, CAST(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS live_bytes, CAST(sum(l_quantity) AS BIGINT) AS total_bytes,
  CAST(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS dead_bytes FROM lineitem GROUP BY l_suppkey
HAVING sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) * 100 >= sum(l_quantity) * 34""")
def extent_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    extents = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("extent")).agg(F.sum(F.when(F.col("l_returnflag") != "R", q).otherwise(0)).cast("bigint").alias("live_bytes"), F.sum(q).cast("bigint").alias("total_bytes"))
    return objects.compaction_candidates(extents, 34)


@query("SELECT o_orderkey AS upload FROM orders WHERE o_orderstatus = 'O' AND epoch(o_orderdate) <= 900000000 - (o_orderkey % 30) * 86400")
def stale_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.tables import seconds

    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("upload"), F.when(F.col("o_orderstatus") == "O", "open").otherwise("done").alias("status"), seconds("o_orderdate").alias("initiated"))
    return objects.stale_uploads(o, F.col("upload") % 30, 900_000_000).select("upload")


_TREE = f"""{PATHS_SQL}, own AS (SELECT path, max(size) AS size FROM paths GROUP BY path),
dirs AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS path FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i FROM paths) x),
tree AS (SELECT path, 'file' AS kind, size FROM own WHERE path NOT IN (SELECT path FROM dirs) UNION ALL SELECT path, 'dir', 0 FROM dirs)"""


def _tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.with_ancestors(paths(spark, sf_dir).select("path", "size"))


@query(f"WITH {_TREE} SELECT * FROM tree")
def tree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tree(spark, sf_dir)


@query(f"WITH {_TREE} SELECT count(*) FILTER (kind = 'file') AS file_count, count(*) FILTER (kind = 'dir') + 1 AS directory_count, CAST(sum(CASE WHEN kind = 'file' THEN size ELSE 0 END) AS BIGINT) AS logical_bytes FROM tree")
def tree_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.counters(_tree(spark, sf_dir))


@query(f"""WITH {_TREE}, t AS (SELECT *, regexp_replace(path, '/?[^/]*$', '') AS parent FROM tree WHERE NOT (kind = 'dir' AND length(path) % 4 = 1))
SELECT path, kind, size FROM t WHERE parent <> '' AND parent NOT IN (SELECT path FROM t WHERE kind = 'dir')""")
def tree_missing_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.missing_parents(_tree(spark, sf_dir).filter(~((F.col("kind") == "dir") & (F.length("path") % 4 == 1))))


@query(f"""WITH {_TREE}, b AS (SELECT path, kind, CASE WHEN size % 5 = 2 THEN size + 1 ELSE size END AS size FROM tree WHERE length(path) % 9 <> 3 UNION ALL SELECT path || '.new', kind, size FROM tree WHERE length(path) % 9 = 4)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'removed' ELSE 'modified' END AS change
FROM tree a FULL JOIN b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.kind <> b.kind OR a.size <> b.size""")
def tree_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, n = _tree(spark, sf_dir), F.length("path")
    b = a.filter(n % 9 != 3).withColumn("size", F.when(F.col("size") % 5 == 2, F.col("size") + 1).otherwise(F.col("size"))).union(a.filter(n % 9 == 4).withColumn("path", F.concat("path", F.lit(".new"))))
    return trees.diff(a, b)


@query(f"""WITH {_TREE} SELECT array_to_string(p[1:i], '/') AS path, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes
FROM (SELECT string_split(path, '/') AS p, unnest(range(1, len(string_split(path, '/')))) AS i, size FROM tree WHERE kind = 'file') x GROUP BY 1""")
def tree_directory_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trees.directory_sizes(_tree(spark, sf_dir))


@query(f"""WITH {_TREE}, d AS (SELECT path FROM tree WHERE length(path) % 3 = 0 UNION ALL SELECT path || '?' FROM tree WHERE length(path) % 10 = 1),
kept AS (SELECT DISTINCT regexp_replace(path, '/?[^/]*$', '') AS path FROM tree WHERE path NOT IN (SELECT path FROM d))
SELECT d.path, CASE WHEN t.path IS NULL THEN 'missing' ELSE 'not empty' END AS reason FROM d LEFT JOIN tree t ON t.path = d.path LEFT JOIN kept k ON k.path = d.path
WHERE t.path IS NULL OR (t.kind = 'dir' AND k.path IS NOT NULL)""")
def tree_refused_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _tree(spark, sf_dir), F.length("path")
    deletes = t.filter(n % 3 == 0).select("path").union(t.filter(n % 10 == 1).select(F.concat("path", F.lit("?")).alias("path")))
    return trees.refused_deletes(t, deletes)


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped,
  strftime(make_timestamp(page_id * 86461 * 1000000), '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(make_timestamp(page_id * 86461 * 1000000), '%a, %d %b %Y %H:%M:%S GMT') AS http_date,
  regexp_matches(split_part(split_part(url, '://', 2), '/', 1), '^[a-z0-9][a-z0-9.-]{1,61}[a-z0-9]$') AND NOT contains(split_part(split_part(url, '://', 2), '/', 1), '..')
    AND NOT regexp_matches(split_part(split_part(url, '://', 2), '/', 1), '^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$') AS valid_name FROM pages""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, host = F.col("page_id") * 86461, F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))
    return table(spark, sf_dir, "pages").select("page_id", text.xml_escape(F.col("html")).alias("escaped"), text.iso_timestamp(s).alias("iso"), text.http_timestamp(s).alias("http_date"), text.valid_bucket_name(host).alias("valid_name"))


_HEADERS = ["bytes=0-9", "bytes=5-", "bytes=-7", "bytes=2000-3000", "bytes=9-3", "bytes=0-1,3-4", "bytes=-0", "x"]


@query(f"""WITH h(header) AS (VALUES {', '.join(f"('{h}')" for h in _HEADERS)}), d AS (SELECT doc_id, length(text) AS n FROM documents),
p AS (SELECT *, TRY_CAST(nullif(regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 1), '') AS BIGINT) AS a, TRY_CAST(nullif(regexp_extract(header, '^bytes=([0-9]*)-([0-9]*)$', 2), '') AS BIGINT) AS b FROM h, d),
r AS (SELECT *, coalesce(a, greatest(n - b, 0)) AS f, CASE WHEN a IS NULL OR b IS NULL THEN n - 1 ELSE least(b, n - 1) END AS l FROM p)
SELECT doc_id, header, CASE WHEN (a IS NOT NULL OR b > 0) AND n > 0 AND f <= l AND f < n THEN f END AS first, CASE WHEN (a IS NOT NULL OR b > 0) AND n > 0 AND f <= l AND f < n THEN l END AS last FROM r""")
def range_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n"), F.explode(F.array(*map(F.lit, _HEADERS))).alias("header"))
    r = text.byte_range(F.col("header"), F.col("n"))
    return d.select("doc_id", "header", r["first"].alias("first"), r["last"].alias("last"))
