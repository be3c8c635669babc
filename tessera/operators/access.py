"""Access rules and quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import ordered_fold


def authorize(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """request, allowed: denied by default, and an explicit denial wins.

    requests: request, principal, resource_type, resource, operation. rules: principal (or *),
    resource_type, resource, pattern (literal or prefix), operation (or all), effect. A request
    meets literal rules by its resource (or *) and prefix rules by each of its own prefixes, so the
    pattern test is an equi-join.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.length("resource")), lambda n: F.struct(F.lit("prefix").alias("pattern"), F.substring(F.col("resource"), F.lit(1), n).alias("text")))
    literal = F.array(F.struct(F.lit("literal").alias("pattern"), F.col("resource").alias("text")), F.struct(F.lit("literal").alias("pattern"), F.lit("*").alias("text")))
    request = requests.select("request", F.col("principal").alias("who"), "resource_type", F.col("resource"), F.col("operation").alias("wanted"))
    wanted = (F.col("operation") == "all") | (F.col("operation") == F.col("wanted"))
    # rules for everyone and everything would put all requests on one key; distinct, they are as few as the types and operations
    rules = rules.select("principal", "resource_type", "resource", "pattern", "operation", "effect").distinct()
    everything = (F.col("principal") == "*") & (((F.col("pattern") == "literal") & (F.col("resource") == "*")) | ((F.col("pattern") == "prefix") & (F.col("resource") == "")))
    widest = rules.filter(everything).select("resource_type", "operation", "effect").distinct().groupBy("resource_type").agg(F.collect_list(F.struct("operation", "effect")).alias("widest"))
    asked = request.withColumn("p", F.explode(F.concat(literal, prefixes))).withColumn("principal", F.explode(F.array(F.col("who"), F.lit("*"))))
    asked = asked.select("request", "principal", "resource_type", "wanted", "p.pattern", F.col("p.text").alias("resource"))
    hit = asked.join(rules.filter(~everything), ["principal", "resource_type", "pattern", "resource"]).filter(wanted).select("request", "effect")
    wide = request.join(widest, "resource_type").select("request", "wanted", F.explode("widest").alias("w")).select("request", "wanted", "w.*").filter(wanted).select("request", "effect")
    hit = hit.union(wide)
    verdict = hit.groupBy("request").agg(F.some(F.col("effect") == "deny").alias("denied"), F.some(F.col("effect") == "allow").alias("granted"))
    return requests.join(verdict, "request", "left").select("request", (F.coalesce("granted", F.lit(False)) & ~F.coalesce("denied", F.lit(False))).alias("allowed"))


class Bucket:
    """A token bucket: refilled by whole tokens of elapsed time at each call, up to its burst."""

    def __init__(self) -> None:
        self.tokens: float | None = None
        self.last = 0


def admit(requests: DataFrame, rate: int, burst: int) -> DataFrame:
    """key, seq, admitted, tokens: requests (key, seq, at in ms, bytes) against one bucket a key, in order of seq."""

    def step(b: Bucket, row) -> dict:
        if b.tokens is None:
            b.tokens = burst
        else:
            b.tokens = min(burst, b.tokens + max(0, row.at - b.last) * rate // 1000)
        b.last = row.at
        ok = row.bytes <= b.tokens
        if ok:
            b.tokens -= row.bytes
        return {"seq": row.seq, "admitted": bool(ok), "tokens": int(b.tokens)}

    return ordered_fold(requests, ["key"], ["seq"], Bucket, step, "key bigint, seq bigint, admitted boolean, tokens bigint")
