"""Stateful folds of the log: idempotent producers, transactions, consumer groups.

Appends and groups are a state and a pure step: the batch operators fold a sorted table, the
streaming ones (``tessera.streaming``) micro-batches with the same steps. Transactions need no
replay; they are windows and aggregates.
"""

from __future__ import annotations

from heapq import heappop, heappush

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import ordered_fold
from ..functions.prefix import running_total


class Producer:
    """The last accepted batch of a producer in a partition."""

    def __init__(self, epoch: int = -1, base: int = -1, count: int = 0) -> None:
        self.epoch, self.base, self.count = epoch, base, count


def append_step(state: Producer, epoch: int, base: int, count: int) -> str:
    """fenced, duplicate (the last accepted batch again), out_of_order or append, which moves the state."""
    if epoch < state.epoch:
        return "fenced"
    if epoch == state.epoch and (base, count) == (state.base, state.count):
        return "duplicate"
    expected = 0 if epoch > state.epoch else state.base + state.count
    if base != expected:
        return "out_of_order"
    state.epoch, state.base, state.count = epoch, base, count
    return "append"


def decide_appends(batches: DataFrame) -> DataFrame:
    """producer, part, seq, decision. batches: producer, part, seq (arrival), epoch, base, count."""
    step = lambda s, r: {"seq": r.seq, "decision": append_step(s, r.epoch, r.base, r.count)}
    return ordered_fold(batches, ["producer", "part"], ["seq"], Producer, step, "producer bigint, part bigint, seq bigint, decision string")


def fold_transactions(commands: DataFrame, timeout: int) -> DataFrame:
    """producer, seq, status, aborted (parts). commands: producer, seq, op, part, offset, at.

    ops: begin, append, commit, abort, expire. A begin opens a transaction and drops an open one.
    The open one ends at its first commit or abort, or at an expire beyond its deadline, which is
    ``timeout`` after its last begin or append. After the end the same command may repeat; the
    other of the two is an error. aborted names the parts an abort or expiry gives up.

    So nothing is replayed: begins number the transactions of a producer by prefix sums, and a
    transaction's end is a minimum over its own commands.
    """
    op = F.col("op")
    of = ["producer", "transaction"]
    rows = running_total(commands, ["producer"], ["seq"], (op == "begin").cast("int"), "transaction")
    before = Window.partitionBy(*of).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("touched", F.last(F.when(op.isin("begin", "append"), F.col("at")), ignorenulls=True).over(before))
    closes = (F.col("transaction") > 0) & (op.isin("commit", "abort") | ((op == "expire") & (F.col("touched") + timeout <= F.col("at"))))
    ends = rows.filter(closes).groupBy(*of).agg(F.min(F.struct("seq", "op")).alias("end"))
    ends = ends.select(*of, F.col("end.seq").alias("end_seq"), F.when(F.col("end.op") == "commit", "committed").otherwise("aborted").alias("end_status"))
    rows = rows.join(ends, of, "left")
    open_ = F.col("end_seq").isNull() | (F.col("seq") < F.col("end_seq"))
    parts = rows.filter(open_ & (op == "append") & (F.col("end_status") == "aborted")).groupBy(*of).agg(F.sort_array(F.collect_set("part")).alias("parts"))
    rows = rows.join(parts, of, "left")
    asked = F.when(op == "commit", "committed").when(op == "abort", "aborted")
    later = F.when(asked.isNotNull() & (asked != F.col("end_status")), "error").otherwise(F.col("end_status"))
    status = F.when(F.col("transaction") == 0, F.when(asked.isNotNull(), "error").otherwise("empty")).when(open_, "ongoing").when(F.col("seq") == F.col("end_seq"), F.col("end_status")).otherwise(later)
    aborted = F.when(F.col("seq") == F.col("end_seq"), F.col("parts"))
    return rows.select("producer", "seq", status.alias("status"), F.coalesce(aborted, F.array().cast("array<bigint>")).alias("aborted"))


class Group:
    """A group's generation and its members with the time each was last seen.

    Two heaps beside them give who was seen longest ago and the least id, so a command costs the logarithm of the
    members. An entry that the members don't bear out any more is passed over, and a heap of mostly such is made anew.
    """

    def __init__(self) -> None:
        self.generation, self.members = 0, {}
        self._seen: list[tuple[int, str]] = []
        self._ids: list[str] = []

    def see(self, member: str, at: int) -> None:
        if member not in self.members:
            if len(self._ids) > 2 * len(self.members) + 64:
                self._ids = sorted(self.members)
            heappush(self._ids, member)
        self.members[member] = at
        if len(self._seen) > 2 * len(self.members) + 64:
            self._seen = sorted((seen, m) for m, seen in self.members.items())
        else:
            heappush(self._seen, (at, member))

    def expire(self, before: int) -> None:
        """Members last seen before this time leave, each with a new generation."""
        while self._seen and self._seen[0][0] < before:
            seen, member = heappop(self._seen)
            if self.members.get(member) == seen:
                self.leave(member)

    def leave(self, member: str) -> None:
        del self.members[member]
        self.generation += 1

    def leader(self) -> str | None:
        while self._ids and self._ids[0] not in self.members:
            heappop(self._ids)
        return self._ids[0] if self._ids else None


def group_step(g: Group, op: str, member: str, generation: int, at: int, timeout: int) -> str:
    """ok, unknown or fenced. ops: join and leave (a new generation), heartbeat, sync (the leader's, the least id)."""
    g.expire(at - timeout)
    if op == "join":
        g.see(member, at)
        g.generation += 1
        return "ok"
    if member not in g.members:
        return "unknown"
    if op == "leave":
        g.leave(member)
        return "ok"
    if generation != g.generation or (op == "sync" and member != g.leader()):
        return "fenced"
    g.see(member, at)
    return "ok"


def fold_groups(commands: DataFrame, timeout: int) -> DataFrame:
    """group, seq, result, generation, members, leader. commands: group, seq, op, member, generation, at."""

    def step(g: Group, r) -> dict:
        result = group_step(g, r.op, r.member, int(r.generation), int(r.at), timeout)
        return {"seq": r.seq, "result": result, "generation_now": g.generation, "members": len(g.members), "leader": g.leader()}

    return ordered_fold(commands, ["group"], ["seq"], Group, step, "group string, seq bigint, result string, generation_now bigint, members bigint, leader string")
