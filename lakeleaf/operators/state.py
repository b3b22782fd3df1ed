"""Stateful operators over logs: rate limits, cache hits, history validation, retry delays."""

from __future__ import annotations

from collections import OrderedDict, deque
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import checkpoint

WINDOW_S, PER_EMAIL, PER_ADDRESS = 3600, 3, 10


def sessions(requests: DataFrame, key: str, window: int) -> DataFrame:
    """(key, slot, session): a key's slots of ``window`` seconds with requests, and where its stretch without a pause of that length began.

    No pause fits inside a slot, so only the ends of slots are compared, one row for each, however hot the key.
    """
    slots = requests.groupBy(key, F.floor(F.col("ts") / window).alias("slot")).agg(F.min("ts").alias("least"), F.max("ts").alias("most"))
    order = Window.partitionBy(key).orderBy("slot")
    begins = F.coalesce(F.col("least") - F.lag("most").over(order) >= window, F.lit(True))
    return slots.withColumn("_begin", F.when(begins, F.col("slot"))).select(key, "slot", F.last("_begin", ignorenulls=True).over(order).alias("session"))


def bursts(requests: DataFrame, window: int) -> DataFrame:
    """The requests with ``burst``: those that share an e-mail or an address without a pause of ``window`` seconds, directly or through others."""
    rows = requests.withColumn("slot", F.floor(F.col("ts") / window))
    for key, mark in (("email", "e"), ("address", "i")):
        found = sessions(rows, key, window).withColumn(f"_{mark}", F.concat_ws(":", F.lit(mark), "session", key)).drop("session")
        rows = rows.join(found, [key, "slot"])
    roots = key_groups(rows.select(F.col("_e").alias("a"), F.col("_i").alias("b")).distinct())
    return rows.join(roots, F.col("_e") == F.col("key")).select(*requests.columns, F.col("root").alias("burst"))


def rate_limit(requests: DataFrame, per_email: int = PER_EMAIL, per_address: int = PER_ADDRESS, window: int = WINDOW_S) -> DataFrame:
    """(request_id, allowed) of (request_id, email, address, ts seconds), exact (O-240).

    A request counts against its email and its address only if it was allowed, so two keys
    depend on each other through time, but not over a pause as long as the window.
    Requests are cut into bursts by such pauses; each burst is folded in order as a
    stream of sorted rows, which holds the allowed requests of the last window only.
    A null e-mail or address is a key of its own; ties go by request_id.
    """
    rows = requests.select("request_id", F.coalesce("email", F.lit("")).alias("email"), F.coalesce("address", F.lit("")).alias("address"), F.col("ts").cast("double").alias("ts"))

    def folded(batches):
        import pyarrow as pa

        burst, logs, purged = None, {}, 0.0
        for batch in batches:
            allowed = []
            for now, email, address, ts in zip(*(batch.column(c).to_pylist() for c in ("burst", "email", "address", "ts")), strict=True):
                if now != burst:
                    burst, logs, purged = now, {}, ts
                if ts - purged >= window:  # keys that have been idle are forgotten
                    logs, purged = {k: log for k, log in logs.items() if log and log[-1] > ts - window}, ts
                own = [logs.setdefault(k, deque()) for k in (("e", email), ("i", address))]
                for log in own:
                    while log and log[0] <= ts - window:
                        log.popleft()
                ok = len(own[0]) < per_email and len(own[1]) < per_address
                allowed.append(ok)
                if ok:
                    for log in own:
                        log.append(ts)
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(allowed, pa.bool_())], ["request_id", "allowed"])

    placed = bursts(rows, window).repartition("burst").sortWithinPartitions("burst", "ts", "request_id")
    return placed.mapInArrow(folded, f"request_id {rows.schema['request_id'].dataType.simpleString()}, allowed boolean")


def key_groups(links: DataFrame) -> DataFrame:
    """(key, root) of the connected keys of (a, b) links, root the smallest key.

    A key takes the least root among its neighbours, and then the root of its root, so
    that long chains shrink by half or more in each round.
    """
    both = checkpoint(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("key"), "root"))
    while True:
        near = both.join(roots, both["b"] == roots["key"]).groupBy("a").agg(F.min("root").alias("near"))
        step = checkpoint(roots.join(near, roots["key"] == near["a"]).select("key", "root", F.least("root", "near").alias("least")))
        above = step.select(F.col("key").alias("_key"), F.col("least").alias("_root"))
        step = checkpoint(step.join(above, F.col("least") == F.col("_key")).select("key", F.col("_root").alias("root"), (F.col("_root") < F.col("root")).alias("moved")))
        roots = step.select("key", "root")
        if step.filter("moved").isEmpty():
            return roots


def rate_window(requests: DataFrame, key: str, window: int = WINDOW_S) -> DataFrame:
    """Requests of the key in the trailing window, before each; an approximation of the limit, as it counts rejected ones."""
    order = Window.partitionBy(key).orderBy(F.col("ts").cast("timestamp").cast("long")).rangeBetween(-window, -1)
    return requests.withColumn("recent", F.count("*").over(order))


def ttl_hits(requests: DataFrame, key: str, ttl: int = WINDOW_S) -> DataFrame:
    """Whether a request finds an entry that its predecessor for the key left, younger than the time to live (O-241)."""
    gap = F.col("ts").cast("timestamp").cast("long") - F.lag(F.col("ts").cast("timestamp").cast("long")).over(Window.partitionBy(key).orderBy("ts", "event_id"))
    return requests.withColumn("hit", F.coalesce(gap < ttl, F.lit(False)))


@dataclass
class ResponseCache:
    """Least-recently-used entries with a time to live; a new table version clears all (O-241)."""

    size: int = 100
    ttl: float = 3600.0
    version: int | None = None
    entries: OrderedDict = field(default_factory=OrderedDict)
    hits: int = 0
    misses: int = 0

    def get(self, key: str, now: float):
        found = self.entries.get(key)
        if found is None or now - found[1] > self.ttl:
            self.entries.pop(key, None)
            self.misses += 1
            return None
        self.entries.move_to_end(key)
        self.hits += 1
        return found[0]

    def put(self, key: str, value, now: float) -> None:
        self.entries[key] = (value, now)
        self.entries.move_to_end(key)
        while len(self.entries) > self.size:
            self.entries.popitem(last=False)

    def check_version(self, version: int) -> bool:
        changed = self.version is not None and version != self.version
        if changed:
            self.entries.clear()
        self.version = version
        return changed

    def stats(self) -> dict:
        return {"size": len(self.entries), "hits": self.hits, "misses": self.misses}


CACHE_SLICES = 64


class Recent:
    """The most recent distinct keys of a sequence with versions, ``size`` at most: what a least-recently-used cache holds."""

    def __init__(self, size: int, keys: list[str] = (), version=None):
        self.size, self.version = size, version
        self.first = self.cleared = None
        self.keys = OrderedDict((k, None) for k in keys)

    def use(self, key: str, version) -> bool:
        """Whether the key is held; afterwards it is the most recent one."""
        if version is not None:
            if self.version is not None and version != self.version:
                self.keys.clear()
                self.cleared = True
            self.version = version
            self.first = version if self.first is None else self.first
        held = key in self.keys
        self.keys[key] = None
        self.keys.move_to_end(key)
        if len(self.keys) > self.size:
            self.keys.popitem(last=False)
        return held


def carried(summaries: list, size: int) -> dict[int, tuple[list[str], int | None]]:
    """(keys, version) at the start of each slice, from (slice, keys, first version, last version, cleared) of the slices in order."""
    keys, version, out = [], None, {}
    for part, own, first, last, cleared in summaries:
        out[part] = (keys, version)
        fresh = cleared or (first is not None and version is not None and first != version)
        seen = dict.fromkeys(own)
        keys = (list(own) if fresh else [k for k in keys if k not in seen] + list(own))[-size:]
        version = version if last is None else last
    return out


def cache_hits(requests: DataFrame, size: int = 100, ttl: float = 3600.0, slices: int = CACHE_SLICES) -> DataFrame:
    """(request_id, hit) of (request_id, key, ts seconds, version): hits of one least-recently-used cache with a time to live (O-241).

    Every request leaves its key the most recent, so the cache holds the last ``size``
    distinct keys since the version last changed, whatever has expired.  The log is
    cut into ``slices`` ranges of time.  A slice streams through ``size`` keys; what it leaves,
    size keys at most, is carried over the slices on the driver (slices * size
    keys), and each slice is then replayed from its start.  Expiry depends on the
    key's own hits alone and is a fold over its rows, streamed in order.

    A null version is no change of it; a null key is a key of its own; ties go by request_id.
    """
    ident = requests.schema["request_id"].dataType.simpleString()
    rows = requests.select("request_id", F.concat(F.when(F.col("key").isNull(), "n").otherwise("k"), F.coalesce("key", F.lit(""))).alias("key"), F.col("ts").cast("double").alias("ts"), F.col("version").cast("long").alias("version"))
    dealt = checkpoint(rows.repartitionByRange(slices, "ts", "request_id").withColumn("slice", F.spark_partition_id()))
    ordered = dealt.repartition(slices, "slice").sortWithinPartitions("slice", "ts", "request_id")

    def summed(batches):
        import pyarrow as pa

        def row():
            return pa.RecordBatch.from_pylist([{"slice": part, "keys": list(held.keys), "first": held.first, "last": held.version, "cleared": bool(held.cleared)}], schema)

        schema = pa.schema([("slice", pa.int32()), ("keys", pa.list_(pa.string())), ("first", pa.int64()), ("last", pa.int64()), ("cleared", pa.bool_())])
        part, held = None, None
        for batch in batches:
            for now, key, version in zip(*(batch.column(c).to_pylist() for c in ("slice", "key", "version")), strict=True):
                if now != part:
                    if held is not None:
                        yield row()
                    part, held = now, Recent(size)
                held.use(key, version)
        if held is not None:
            yield row()

    ends = ordered.mapInArrow(summed, "slice int, keys array<string>, first long, last long, cleared boolean").orderBy("slice").collect()
    starts = carried([tuple(r) for r in ends], size)

    def replayed(batches):
        import pyarrow as pa

        part, held = None, None
        for batch in batches:
            found = []
            for now, key, version in zip(*(batch.column(c).to_pylist() for c in ("slice", "key", "version")), strict=True):
                if now != part:
                    part, held = now, Recent(size, *starts[now])
                found.append(held.use(key, version))
            yield batch.select(["request_id", "key", "ts"]).append_column("held", pa.array(found, pa.bool_()))

    def expired(batches):
        import pyarrow as pa

        key, put = None, 0.0
        for batch in batches:
            hits = []
            for now, ts, held in zip(*(batch.column(c).to_pylist() for c in ("key", "ts", "held")), strict=True):
                hit = held and now == key and ts - put <= ttl
                if not hit:
                    key, put = now, ts
                hits.append(hit)
            yield pa.RecordBatch.from_arrays([batch.column("request_id"), pa.array(hits, pa.bool_())], ["request_id", "hit"])

    used = ordered.mapInArrow(replayed, f"request_id {ident}, key string, ts double, held boolean")
    return used.repartition("key").sortWithinPartitions("key", "ts", "request_id").mapInArrow(expired, f"request_id {ident}, hit boolean")


def retry_delay(attempt: Column, base: float = 0.5, most: float = 4.0, jitter: Column | None = None) -> Column:
    """min(base * 2^n, most), times 1 + jitter in [-0.25, 0.25] (O-243)."""
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), attempt), F.lit(most))
    return delay if jitter is None else delay * (1 + jitter)


def valid_history(turns: DataFrame, first: int = 20, most_chars: int = 5000) -> DataFrame:
    """(conv_id, position, role, text): the turns that a conversation may keep (O-245).

    Of its first turns, those of an unknown role go, then roles must alternate from the
    user on; texts are cut and sanitised; user turns that inject with high
    confidence go without changing whose turn it is.
    """
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= first).filter(F.col("role").isin("user", "assistant"))
    rows = rows.withColumn("text", T.sanitize(F.substring(F.coalesce("text", F.lit("")), 1, most_chars)))
    rows = rows.withColumn("_bad", (F.col("role") == "user") & F.coalesce(T.injection_severity(F.col("text")) == "high", F.lit(False)))
    per = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "_bad"))).alias("t"))  # 20 turns at most
    kept = per.withColumn(
        "k",
        F.expr("""
        aggregate(t, named_struct('kept', cast(array() as array<struct<turn:bigint,role:string,text:string>>), 'want', 'user'),
          (a, x) -> case
            when x.role <> a.want then a
            when x._bad then a
            else named_struct('kept', concat(a.kept, array(named_struct('turn', cast(x.turn as bigint), 'role', x.role, 'text', x.text))), 'want', if(a.want = 'user', 'assistant', 'user')) end,
          a -> a.kept)"""),
    )
    return kept.select("conv_id", F.posexplode("k").alias("position", "x")).select("conv_id", "position", F.col("x.turn").alias("turn"), F.col("x.role").alias("role"), F.col("x.text").alias("text"))


def multi_turn(history: DataFrame, current: DataFrame) -> DataFrame:
    """(conv_id, contents): history with assistants as models, and the current question (O-247)."""
    role = F.when(F.col("role") == "assistant", F.lit("model")).otherwise(F.col("role"))
    per = history.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("position", role.alias("role"), F.substring("text", 1, 15_000).alias("text")))).alias("h"))
    rows = current.join(per, "conv_id", "left")
    shaped = F.transform(F.coalesce("h", F.expr("cast(array() as array<struct<position:int,role:string,text:string>>)")), lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return rows.select("conv_id", F.array_append(shaped, F.struct(F.lit("user").alias("role"), F.col("question").alias("text"))).alias("contents"))
