"""Conversation turn reassembly: turns that arrive out of order, repeated and late become gapless conversations.

Arrivals are dealt to buckets by a hash, and one call of applyInPandasWithState
serves a whole bucket in a batch.  A tick row per bucket and batch wakes every
bucket, so conversations also close where nothing arrives.  A bucket's state is
a zstd block of columns: a row per conversation, and the kept turns that wait
for an earlier one.  Batches are merged into it with sorts and masks: the first
arrival of a turn wins, and the run of turns without a gap is released.

A conversation is cut into parts of ``span`` turns, each a row of its own bucket, so a
conversation that holds a third of all rows spreads over many buckets.  Parts
of one conversation hear of each other's arrivals by presence rows; what a
part may release, once all parts before it are full, is settled by joins on
the rows that the stream has written.  The number of buckets follows the rows.

Defined cases: a null turn is dropped; a null role or text is empty; rows
with a null conv_id form one conversation; of the arrivals of a turn in one batch
the smallest ``role|text`` (UTF-8 bytes, then the role) counts; extra columns
are ignored; an empty table gives no events.  Only the list of a conversation's unreleased
turn numbers, which one digest covers, is gathered in one row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from .common import drop, renamed, scratch

BATCHES, IDLE = 12, 3
SPAN, BUCKET_ROWS = 4096, 2000
TICK, ARRIVAL, PRESENCE = 0, 1, 2
KEY = ["conv_id", "no_id", "part"]
FEED = "bucket long, batch int, kind int, conv_id long, no_id boolean, part long, start long, split boolean, turn long, role string, text string"
EVENTS = (
    "event string, conv_id long, no_id boolean, part long, start long, split boolean, batch int, turn long, role string, text string, "
    "turns array<long>, released long, largest long, breaks long, head string, tail string, full int"
)
COLUMNS = [c.split()[0] for c in EVENTS.split(", ")]


# --- State of a bucket ---


def empty_state() -> tuple[pd.DataFrame, pd.DataFrame]:
    """(parts, waiting): a row per part of a conversation, and its kept turns that are not released."""
    parts = {"conv_id": "int64", "no_id": bool, "part": "int64", "start": "int64", "split": bool, "released": "int64", "breaks": "int64", "head": object, "last": object, "active": "int64", "full": "int64", "closed": bool}
    waiting = {"row": "int64", "turn": "int64", "role": object, "text": object}
    return tuple(pd.DataFrame({c: pd.Series(dtype=t) for c, t in columns.items()}) for columns in (parts, waiting))


def packed(*frames: pd.DataFrame) -> bytes:
    """Columns of the frames as one zstd block."""
    import pyarrow as pa
    import zstandard

    blocks = []
    for frame in frames:
        out = pa.BufferOutputStream()
        rows = pa.Table.from_pandas(frame, preserve_index=False)
        with pa.ipc.new_stream(out, rows.schema) as writer:
            writer.write_table(rows)
        block = out.getvalue().to_pybytes()
        blocks += [len(block).to_bytes(8, "little"), block]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(blocks))


def unpacked(block: bytes) -> list[pd.DataFrame]:
    import pyarrow as pa
    import zstandard

    data, at, frames = zstandard.ZstdDecompressor().decompress(block), 0, []
    while at < len(data):
        size = int.from_bytes(data[at : at + 8], "little")
        frames.append(pa.ipc.open_stream(data[at + 8 : at + 8 + size]).read_all().to_pandas())
        at += 8 + size
    return frames


def advance(parts: pd.DataFrame, waiting: pd.DataFrame, rows: pd.DataFrame, batch: int, last: bool, idle: int, span: int):
    """The state after a batch, and its events."""
    fresh = rows[KEY + ["start", "split"]].drop_duplicates(KEY)
    known = pd.MultiIndex.from_frame(parts[KEY])
    fresh = fresh[~pd.MultiIndex.from_frame(fresh[KEY]).isin(known)]
    fresh = fresh.assign(released=0, breaks=0, head=None, last=None, active=batch, full=-1, closed=False)
    parts = pd.concat([parts, fresh], ignore_index=True) if len(parts) else fresh.reset_index(drop=True)
    start, split, released, breaks, head, tail, active, full, closed = (parts[c].to_numpy(copy=True) for c in ("start", "split", "released", "breaks", "head", "last", "active", "full", "closed"))
    number = pd.MultiIndex.from_frame(parts[KEY]).get_indexer(pd.MultiIndex.from_frame(rows[KEY]))
    arrived, shut = rows["kind"].to_numpy() == ARRIVAL, closed[number]
    events = [events_of("reject", parts, number[arrived & shut], batch, **{c: rows[c].to_numpy()[arrived & shut] for c in ("turn", "role", "text")})]
    active[number[~shut]] = batch

    # First arrival wins: waiting turns stand before new ones, and released turns are known by their number.
    use = arrived & ~shut
    use[use] = rows["turn"].to_numpy()[use] >= (start + released)[number[use]]
    row = np.concatenate([waiting["row"].to_numpy(), number[use]]).astype(np.int64)
    turn = np.concatenate([waiting["turn"].to_numpy(), rows["turn"].to_numpy()[use]]).astype(np.int64)
    role, text = (np.concatenate([waiting[c].to_numpy(object), rows[c].to_numpy(object)[use]]) for c in ("role", "text"))
    order = np.lexsort((np.arange(len(row)), turn, row))
    row, turn, role, text = row[order], turn[order], role[order], text[order]
    one = np.ones(len(row), bool)
    one[1:] = (row[1:] != row[:-1]) | (turn[1:] != turn[:-1])
    row, turn, role, text = row[one], turn[one], role[one], text[one]

    # A turn is in the gapless run if its number less its rank among the waiting turns is the next one to release.
    begins = np.searchsorted(row, row, "left")
    rank = np.arange(len(row)) - begins
    out = turn - rank == (start + released)[row]
    before = np.where(rank > 0, np.roll(role, 1), tail[row]) if len(row) else role
    np.add.at(breaks, row[out & (before == role) & ((rank > 0) | (released[row] > 0))], 1)
    opened = out & (turn == start[row])
    head[row[opened]] = role[opened]
    tail[row[out]] = role[out]  # rows are in order, so the last of a part stays
    released += np.bincount(row[out], minlength=len(parts)).astype(np.int64)
    full[(released == span) & (full < 0)] = batch
    events.append(events_of("release", parts, row[out], batch, turn=turn[out], role=role[out], text=text[out]))
    row, turn, role, text = row[~out], turn[~out], role[~out], text[~out]

    # Parts without an arrival in ``idle`` batches close; in the end all do.
    close = ~closed & (last | (active <= batch - idle))
    if close.any():
        gone = np.flatnonzero(close)
        lists = np.split(turn, np.searchsorted(row, np.arange(1, len(parts)))) if len(parts) > 1 else [turn]
        near = np.zeros(len(row), bool)
        near[1:] = (row[1:] == row[:-1]) & (turn[1:] == turn[:-1] + 1) & (role[1:] == role[:-1])
        inside = breaks + np.bincount(row[near], minlength=len(parts))
        largest = np.array([x[-1] if len(x) else s + r - 1 for x, s, r in zip(lists, start, released, strict=True)], np.int64)
        edge = np.where(released == span, tail, None)
        at_edge = turn == (start + span - 1)[row]
        edge[row[at_edge]] = role[at_edge]
        turns = np.empty(len(gone), object)
        turns[:] = [lists[i] for i in gone]
        ends = {"released": released, "largest": largest, "breaks": inside, "head": head, "tail": edge}
        events.append(events_of("close", parts, gone, batch, turn=-1, turns=turns, full=pd.array(np.where(full[gone] < 0, None, full[gone]), "Int64"), **{k: v[gone] for k, v in ends.items()}))
        closed |= close
        stay = ~close[row]
        row, turn, role, text = row[stay], turn[stay], role[stay], text[stay]
        head[close], tail[close] = None, None
    parts = parts.assign(released=released, breaks=breaks, head=head, last=tail, active=active, full=full, closed=closed)
    return parts, pd.DataFrame({"row": row, "turn": turn, "role": role, "text": text}), events


def events_of(kind: str, parts: pd.DataFrame, at: np.ndarray, batch: int, **columns) -> pd.DataFrame:
    own = parts.iloc[at][KEY + ["start", "split"]].reset_index(drop=True)
    given = own.assign(event=kind, batch=batch, **columns)
    return given.assign(**{c: pd.Series([None] * len(own), dtype=object) for c in COLUMNS if c not in given})[COLUMNS]


def bucket_step(last_batch: int, idle: int, span: int):
    def step(key: tuple, frames: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        parts, waiting = unpacked(state.get[0]) if state.exists else empty_state()
        rows = pd.concat(list(frames), ignore_index=True)
        for batch, now in rows.groupby("batch", sort=True):  # one, as a start feeds one batch
            parts, waiting, events = advance(parts, waiting, now[now["kind"] != TICK].reset_index(drop=True), int(batch), batch == last_batch, idle, span)
            yield from (e for e in events if len(e))
        state.update((packed(parts, waiting),))

    return step


# --- Feed ---


def feed(arrivals: DataFrame, buckets: int, batches: int, span: int) -> DataFrame:
    """Rows of FEED for the batches 0 to ``batches`` (the last has ticks only) from (conv_id, turn, role, text, batch)."""
    spark = arrivals.sparkSession
    rows = arrivals.filter("turn is not null").select(
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv_id"), F.col("conv_id").isNull().alias("no_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.col("batch").cast("int").alias("batch"),
    )
    conv = ["conv_id", "no_id"]
    firsts = rows.groupBy(*conv).agg(F.min("turn").alias("first"), (F.max("turn") - F.min("turn") >= span).alias("split")).hint("merge")
    part = F.floor((F.col("turn") - F.col("first")) / span) if span == 1 else F.expr(f"(turn - first) div {span}")
    placed = lambda df: df.join(firsts, conv).withColumn("part", part).withColumn("start", F.col("first") + F.col("part") * span)
    smallest = rows.groupBy("batch", *conv, "turn").agg(F.min(F.struct(F.concat_ws("|", "role", "text").alias("payload"), "role", "text")).alias("p"))
    arrived = placed(smallest).select("batch", F.lit(ARRIVAL).alias("kind"), *KEY, "start", "split", "turn", "p.role", "p.text")
    cut = placed(rows.select(*conv, "turn", "batch")).filter("split")
    presence = cut.select(*KEY, "start", "split").distinct().join(cut.select(*conv, "batch").distinct().hint("merge"), conv)
    none = [F.lit(0).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")]
    dealt = arrived.unionByName(presence.select("batch", F.lit(PRESENCE).alias("kind"), *KEY, "start", "split", *none))
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)))
    tick = [F.lit(TICK).alias("kind"), *(F.lit(0).cast("long").alias(c) for c in ("conv_id", "part", "start")), *(F.lit(False).alias(c) for c in ("no_id", "split"))]
    ticks = spark.range(buckets * (batches + 1)).select((F.col("id") % buckets).alias("bucket"), F.expr(f"cast(id div {buckets} as int)").alias("batch"), *tick, *none)
    return dealt.unionByName(ticks).select(*(c.split()[0] for c in FEED.split(", ")))


def streamed(rows: DataFrame, batches: int, idle: int, span: int) -> DataFrame:
    """Feeds the batches in order to one stateful query, started anew for each on one checkpoint; its events."""
    spark = rows.sparkSession
    base = scratch(spark, "turns")
    rows.withColumn("feed", F.col("batch")).write.partitionBy("feed").parquet(f"{base}/staged")
    for batch in range(batches + 1):
        renamed(spark, f"{base}/staged/feed={batch}", f"{base}/inbox/{batch:06}")
        source = spark.readStream.schema(FEED).parquet(f"{base}/inbox/*")
        events = source.groupBy("bucket").applyInPandasWithState(bucket_step(batches, idle, span), EVENTS, "state binary", "append", GroupStateTimeout.NoTimeout)
        sink = events.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
        sink.start(f"{base}/events").awaitTermination()
    for done in ("inbox", "staged", "checkpoint"):
        drop(spark, f"{base}/{done}")
    return spark.read.schema(EVENTS).parquet(f"{base}/events")


# --- Conversations of several parts ---


def settled(events: DataFrame) -> DataFrame:
    """event, conv_id, turn, batch, role, text, turns, n_missing, n_breaks.

    A part is reached when all parts before it are full, and releases its turns no earlier
    than that; what a part that is never reached let go stays unreleased.
    """
    conv = ["conv_id", "no_id"]
    whole = events.filter("not split").withColumn("n_missing", F.col("largest") - F.col("start") + 1 - F.col("released") - F.size("turns")).withColumnRenamed("breaks", "n_breaks")
    order = Window.partitionBy(*conv).orderBy("part")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = events.filter("split and event = 'close'").select(
        *KEY, "start", "batch", "turns", "released", "largest", "head", "breaks",
        ((F.row_number().over(order) - 1 == F.col("part")) & (F.coalesce(F.count("full").over(earlier), F.lit(0)) == F.col("part"))).alias("reached"),
        F.coalesce(F.max("full").over(earlier), F.lit(-1)).alias("reached_in"),
        F.coalesce((F.lag("part").over(order) == F.col("part") - 1) & (F.lag("tail").over(order) == F.col("head")), F.lit(False)).cast("long").alias("across"),
    )
    gone = events.filter("split and event = 'release'").join(ends.filter("reached").select(*KEY, "reached_in"), KEY).withColumn("batch", F.greatest("batch", "reached_in"))
    kept_back = F.when(F.col("reached") | (F.col("released") == 0), F.col("turns")).otherwise(F.concat(F.expr("sequence(start, start + greatest(released, 1) - 1)"), "turns"))
    sums = ends.withColumn("list", kept_back).groupBy(*conv, "batch").agg(
        (F.max("largest") - F.min("start") + 1 - F.sum(F.col("released") + F.size("turns"))).alias("n_missing"),
        F.sum(F.col("breaks") + F.col("across")).alias("n_breaks"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part", "list"))), lambda x: x["list"])).alias("turns"),
    )
    closed = sums.withColumns({"event": F.lit("close"), "turn": F.lit(-1).cast("long"), "role": F.lit(None).cast("string"), "text": F.lit(None).cast("string")})
    none = {c: F.lit(None).cast(t) for c, t in (("turns", "array<long>"), ("n_missing", "long"), ("n_breaks", "long"))}
    columns = [F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"), "event", "turn", F.col("batch").cast("long").alias("batch"), "role", "text", "turns", "n_missing", "n_breaks"]
    late = events.filter("split and event = 'reject'").withColumns(none)
    return whole.select(*columns).unionByName(gone.withColumns(none).select(*columns)).unionByName(late.select(*columns)).unionByName(closed.select(*columns))


def reassemble(arrivals: DataFrame, batches: int = BATCHES, idle: int = IDLE, span: int = SPAN, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Events of (conv_id, turn, role, text, batch) arrivals, batch 0 to ``batches`` - 1: what was released, rejected and closed when.

    A release or reject has its turn, role and text; a close has the unreleased turns in order,
    how many turns up to the largest kept one are missing, and how many repeat the role before them.
    """
    buckets = max(1, -(-arrivals.count() // bucket_rows))
    return settled(streamed(feed(arrivals, buckets, batches, span), batches, idle, span))


def scheduled(conversations: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Arrivals of a table of conversations: a batch for every turn by hash, and for some a second one in the name of the user."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"), F.col("turn").cast("string"))
    h = F.conv(F.substring(F.sha2(key.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    rows = conversations.filter("turn is not null").select("conv_id", "turn", "role", "text", h.alias("h"))
    own = F.struct((F.col("h") % batches).alias("batch"), F.col("role").alias("role"))
    again = F.when(F.col("h") % 7 < 2, F.struct(((F.col("h") + 3) % batches).alias("batch"), F.lit("user").alias("role")))
    return rows.select("conv_id", "turn", "text", F.explode(F.array_compact(F.array(own, again))).alias("a")).select("conv_id", "turn", "a.role", "text", "a.batch")


def digests(events: DataFrame) -> DataFrame:
    """The events with a digest in place of their text."""
    payload = F.when(F.col("event") == "close", F.array_join(F.transform("turns", lambda x: x.cast("string")), ",")).otherwise(F.concat_ws("|", "role", "text"))
    return events.select("event", "conv_id", "turn", "batch", F.sha2(payload.cast("binary"), 256).alias("sha256"), "n_missing", "n_breaks")


def reassembly_sql(batches: int = BATCHES, idle: int = IDLE) -> str:
    """DuckDB SQL for ``digests(reassemble(scheduled(...)))``: a turn is released in the latest batch of the run up to it."""
    return f"""
with named as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text,
    cast('0x' || substr(sha256(coalesce(cast(conv_id as varchar), '') || ':' || cast(turn as varchar)), 1, 8) as bigint) as h from conversations where turn is not null),
sent as (select conv_id, turn, role, text, h % {batches} as batch from named union all select conv_id, turn, 'user', text, (h + 3) % {batches} from named where h % 7 < 2),
arrivals as (select conv_id, turn, batch, min(struct_pack(p := role || '|' || text, r := role)) as a from sent group by all),
firsts as (select conv_id, min(turn) as first from named group by 1),
active as (select conv_id, batch, lead(batch) over (partition by conv_id order by batch) as later from (select distinct conv_id, batch from arrivals)),
ends as (select conv_id, case when min(batch) + {idle} < {batches} then min(batch) + {idle} else {batches} end as closes from active where later is null or later > batch + {idle} group by 1),
placed as (select a.*, closes from arrivals a join ends e on a.conv_id is not distinct from e.conv_id),
kept as (select conv_id, turn, min(batch) as batch, arg_min(a, batch) as a from placed where batch <= closes group by 1, 2),
runs as (select k.*, first, lag(turn) over w as before, lag(a.r) over w as role_before, turn - (row_number() over w) + 1 = first as runs, max(batch) over (w rows unbounded preceding) as out
    from kept k join firsts f on k.conv_id is not distinct from f.conv_id window w as (partition by k.conv_id order by turn)),
sums as (select conv_id, max(turn) - min(first) + 1 - count(*) as n_missing, count(*) filter (where before = turn - 1 and role_before = a.r) as n_breaks,
    coalesce(string_agg(cast(turn as varchar), ',' order by turn) filter (where not runs), '') as list from runs group by 1)
select 'release' as event, conv_id, turn, cast(out as bigint) as batch, sha256(a.p) as sha256, cast(null as bigint) as n_missing, cast(null as bigint) as n_breaks from runs where runs
union all select 'reject', conv_id, turn, batch, sha256(a.p), null, null from placed where batch > closes
union all select 'close', s.conv_id, -1, closes, sha256(list), n_missing, n_breaks from sums s join ends e on s.conv_id is not distinct from e.conv_id"""
