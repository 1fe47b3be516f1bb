"""Sliding-log rate limiter for ordered request tables.

A request is admitted when fewer than ``max_requests`` *admitted* requests of
the same user are younger than the window.  Rejected requests use no quota, so
this is not a window count: each admission depends on those before it.

How it is spread over a cluster
    Only the user, time and order columns (and whatever narrow columns the
    caller left in) are shuffled, by user, sorted, and streamed through
    Arrow batches; a task keeps at most the live stamps of one user.

Hot users
    A user with more than ``hot_rows`` rows is cut into chunks of at most that
    many rows along time, each its own shuffle key.  A chunk needs the stamps alive when it starts.  First
    all chunks run as if none were; then every chunk whose entering stamps turn
    out different is run again, until nothing changes, which is the sequential
    result.  Where the user is below the limit for one window somewhere in each
    chunk, the second round is the last.  A user saturated throughout needs a
    round per chunk, since every admission then depends on the one before; the
    rounds move only the narrow columns, and no task ever holds more than a
    chunk's sorted stream.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.rules import ANONYMOUS, MAX_REQUESTS, WINDOW_US
from ..session import ensure_checkpoint_dir

HOT_ROWS = 20_000_000
LOOKAHEAD = 64
_NO_CAP = 2**62
_KEYS = ("_user", "_chunk", "_us", "_seq", "_cap", "_seed")


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; zoneless times are read in the session
    zone, which should be UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def admit(us: np.ndarray, caps: np.ndarray, live: list[int], window: int):
    """One user's requests in order.  *live* holds the admitted stamps to start
    from; returns (limited, retry_after, live stamps at the end)."""
    n = len(us)
    limited = np.zeros(n, dtype=bool)
    retry = np.zeros(n, dtype=np.int64)
    kept = deque(live)
    times, limits = us.tolist(), caps.tolist()
    changes = np.append(np.flatnonzero(np.diff(caps)) + 1, n).tolist()
    at, run = 0, 0
    while at < n:
        now = times[at]
        while kept and now - kept[0] >= window:
            kept.popleft()
        if len(kept) < limits[at]:
            kept.append(now)
            at += 1
            continue
        # nothing changes until the oldest stamp expires or the limit moves
        while changes[run] <= at:
            run += 1
        end = min(int(np.searchsorted(us, kept[0] + window)), changes[run])
        limited[at:end] = True
        retry[at:end] = (window - (us[at:end] - kept[0])) // 1_000_000 + 1
        at = end
    return limited, retry, list(kept)


def _int64(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def _groups(batch: pa.RecordBatch) -> np.ndarray:
    """Start offsets of the runs of equal (user, chunk), plus the row count."""
    n = batch.num_rows
    users, chunks = batch.column("_user"), batch.column("_chunk")
    new = pc.or_(pc.not_equal(users.slice(1), users.slice(0, n - 1)),
                 pc.not_equal(chunks.slice(1), chunks.slice(0, n - 1)))
    inner = np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1
    return np.concatenate(([0], inner, [n])).astype(np.int64)


def _runs(batches: Iterator[pa.RecordBatch], window: int, every_state: bool):
    """Yields (batch, limited, retry, states): decisions for each sorted batch
    and the (user, chunk, live) of groups known to have ended.

    Groups that never reach the limit are settled together by comparing each
    stamp with the one ``cap`` places earlier; only the others are walked.
    """
    key, live = None, []
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        us, caps = _int64(batch, "_us"), _int64(batch, "_cap")
        seed = batch.column("_seed").to_numpy(zero_copy_only=False).astype(bool)
        users, chunks = batch.column("_user"), batch.column("_chunk")
        edges = _groups(batch)
        group_of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
        limited = np.zeros(n, dtype=bool)
        retry = np.zeros(n, dtype=np.int64)
        least = max(int(caps.min()), 0)
        if least >= n:
            walk = set()
        elif least == 0:
            walk = set(range(len(edges) - 1))
        else:
            near = (us[least:] - us[:-least] < window) & (group_of[least:] == group_of[:-least])
            walk = set(np.unique(group_of[least:][near]).tolist())
        states = []
        if key is not None:
            if key == (users[0].as_py(), chunks[0].as_py()):
                walk.add(0)
            else:
                states.append((*key, live))
                live = []
        last = len(edges) - 2
        looked_at = range(last + 1) if every_state else sorted(walk | {last})
        for g in looked_at:
            a, b = int(edges[g]), int(edges[g + 1])
            begin = live if g == 0 else []
            if g in walk:
                limited[a:b], retry[a:b], end = admit(us[a:b], caps[a:b], begin, window)
            else:
                end = us[a:b][us[b - 1] - us[a:b] < window].tolist()
            if g < last:
                if every_state:
                    states.append((users[a].as_py(), chunks[a].as_py(), end))
            else:
                key, live = (users[a].as_py(), chunks[a].as_py()), end
        yield batch, limited, retry, seed, states
    if key is not None:
        yield None, None, None, None, [(*key, live)]


def _decide(window: int, names: list[str]):
    def run(batches):
        for batch, limited, retry, seed, _ in _runs(batches, window, False):
            if batch is None:
                continue
            arrays = [batch.column(c) for c in names]
            arrays.append(pa.array(limited))
            arrays.append(pa.array(retry, mask=~limited))
            out = pa.RecordBatch.from_arrays(arrays, names=[*names, "limited", "retry_after"])
            yield out.filter(pa.array(~seed)) if seed.any() else out
    return run


def _leave(window: int):
    def run(batches):
        for *_, states in _runs(batches, window, True):
            if states:
                users, chunks, stamps = zip(*states)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(users, pa.string()), pa.array(chunks, pa.int64()),
                     pa.array(stamps, pa.list_(pa.int64()))],
                    names=["_user", "_chunk", "stamps"])
    return run


def _in_order(rows: DataFrame) -> DataFrame:
    return (rows.repartition("_user", "_chunk")
            .sortWithinPartitions("_user", "_chunk", F.desc("_seed"), "_us", "_seq"))


def _seed_rows(entering: DataFrame) -> DataFrame:
    return entering.select(
        "_user", "_chunk", F.explode("stamps").alias("_us"), F.lit(-1).cast("long").alias("_seq"),
        F.lit(_NO_CAP).cast("long").alias("_cap"), F.lit(True).alias("_seed"))


def _cut_hot_users(rows: DataFrame, n: int, hot_rows: int) -> DataFrame:
    """The *n* rows of the hot users with ``_chunk``, numbered from 0 per user in
    order of time and seq.  Chunks are cut by rows, so a burst in one instant is
    split too and no chunk holds more than *hot_rows*."""
    place = F.monotonically_increasing_id()       # partition << 33 plus place in it
    dealt = (rows.drop("_chunk").repartitionByRange(2 * -(-n // hot_rows), "_user", "_us", "_seq")
             .sortWithinPartitions("_user", "_us", "_seq").withColumn("_place", place)
             .withColumn("_piece", F.expr(f"struct(shiftright(_place, 33) AS part, (_place & {2**33 - 1}) div {hot_rows} AS at)"))
             .drop("_place").checkpoint())
    numbers = dealt.select("_user", "_piece").distinct().withColumn(
        "_chunk", (F.row_number().over(W.partitionBy("_user").orderBy("_piece")) - 1).cast("long"))
    return dealt.join(numbers, ["_user", "_piece"]).drop("_piece")


def _entering_stamps(rows: DataFrame, window: int, lookahead: int, carried: DataFrame | None) -> DataFrame:
    """(user, chunk, stamps) alive at the start of every later chunk of the hot
    users, by repeating chunks until their entering stamps stand still.
    *carried* are the stamps their first chunks start from."""
    leave_schema = "_user string, _chunk long, stamps array<bigint>"
    chunks = rows.select("_user", "_chunk").distinct()

    def leaving(part: DataFrame, seeds: DataFrame | None, turn: int) -> DataFrame:
        part = part.withColumn("_seed", F.lit(False))
        if seeds is not None:
            part = part.unionByName(seeds)
        return (_in_order(part).mapInArrow(_leave(window), leave_schema)
                .withColumn("turn", F.lit(turn)).checkpoint())

    def newest(old: DataFrame, new: DataFrame) -> DataFrame:
        return (old.unionByName(new).groupBy("_user", "_chunk")
                .agg(F.max_by("stamps", "turn").alias("stamps"), F.max("turn").alias("turn"))
                .checkpoint())

    if carried is not None:
        carried = carried.join(rows.select("_user").distinct(), "_user", "left_semi").select(*_KEYS)
    left = leaving(rows, carried, 0)
    used = rows.sparkSession.createDataFrame([], leave_schema + ", turn int")
    key = ["_user", "_chunk"]
    for turn in count(1):
        now = (left.select("_user", (F.col("_chunk") + 1).alias("_chunk"), "stamps")
               .join(chunks, key, "left_semi"))
        stale = (
            now.join(used.select(*key, F.col("stamps").alias("old")), key, "left")
            .where(F.coalesce("old", F.array().cast("array<bigint>")) != F.col("stamps"))
            .withColumn("_first", F.min("_chunk").over(W.partitionBy("_user")))
            .where(F.col("_chunk") < F.col("_first") + lookahead)
            .select("_user", "_chunk", "stamps", F.lit(turn).alias("turn")).checkpoint()
        )
        if stale.isEmpty():
            return used
        left = newest(left, leaving(
            rows.join(stale.select(key), key, "left_semi"), _seed_rows(stale), turn))
        used = newest(used, stale)


def quota_key(user: str = "user_id", tenant: str | None = None) -> Column:
    """Whose quota a request uses, as a string."""
    who = F.coalesce(F.col(user).cast("string"), F.lit(ANONYMOUS))
    if tenant is None:
        return who
    return F.to_json(F.struct(F.col(tenant).alias("t"), who.alias("u")), {"ignoreNullFields": "false"})


def order_micros(df: DataFrame, ts: str) -> Column:
    return F.col(ts) if dict(df.dtypes)[ts] == "bigint" else micros(F.col(ts))


def rate_limit(df: DataFrame, *, max_requests: int | Column = MAX_REQUESTS,
               window_us: int = WINDOW_US, user: str = "user_id", ts: str = "ts",
               seq: str = "seq", tenant: str | None = None, hot_rows: int = HOT_ROWS,
               lookahead: int = LOOKAHEAD, carried: DataFrame | None = None, counted: DataFrame | None = None) -> DataFrame:
    """Adds ``limited`` and ``retry_after`` (whole seconds, null when admitted).

    Requests are taken in the order of (*ts*, *seq*) per user; a null user is
    ``anonymous``.  *max_requests* may be a column, for limits that change over
    time; a row whose limit is null or below 1 has the default limit, and a null
    time counts as the epoch.  Pass narrow rows: every column of *df* goes through the shuffle.
    With *tenant* each (tenant, user) pair has its own quota.  *carried*
    (quota_key, us) holds stamps admitted before these rows.  Users are counted
    first to find the hot ones; *counted* holds the same requests where their
    user (and tenant) columns are cheaper to read than *df*.
    """
    if not isinstance(max_requests, Column):
        if max_requests < 1:
            raise ValueError("max_requests must be at least 1")
        max_requests = F.lit(max_requests)
    names = df.columns
    cap = max_requests.cast("long")
    keyed = (
        df.withColumn("_user", quota_key(user, tenant)).withColumn("_us", F.coalesce(order_micros(df, ts), F.lit(0)))
        .withColumn("_seq", F.col(seq).cast("long")).withColumn("_cap", F.when(cap >= 1, cap).otherwise(F.lit(MAX_REQUESTS)))
        .withColumn("_chunk", F.lit(0).cast("long"))
    )
    # at most rows / hot_rows users come back
    users = keyed if counted is None else counted.select(quota_key(user, tenant).alias("_user"))
    hot = users.groupBy("_user").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).collect()
    seeds = None if carried is None else _seed_rows(carried.select(
        F.col("quota_key").alias("_user"), F.lit(0).cast("long").alias("_chunk"), F.array("us").alias("stamps")))
    if hot:
        ensure_checkpoint_dir(df.sparkSession)
        is_hot = keyed.sparkSession.createDataFrame([(r["_user"],) for r in hot], "_user string")
        cut = _cut_hot_users(keyed.join(is_hot, "_user", "left_semi"), sum(r["n"] for r in hot), hot_rows)
        later = _seed_rows(_entering_stamps(cut.select("_user", "_chunk", "_us", "_seq", "_cap"), window_us, lookahead, seeds))
        keyed = keyed.join(is_hot, "_user", "left_anti").unionByName(cut)
        seeds = later if seeds is None else seeds.unionByName(later)
    rows = keyed.withColumn("_seed", F.lit(False))
    if seeds is not None:
        rows = rows.unionByName(seeds, allowMissingColumns=True)
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in df.schema.fields],
                           T.StructField("limited", T.BooleanType()),
                           T.StructField("retry_after", T.LongType())])
    return _in_order(rows).mapInArrow(_decide(window_us, names), schema)


def live_stamps(used: DataFrame, before: DataFrame | None, window_us: int, late_us: int | None = None) -> DataFrame:
    """The stamps (quota_key, us) that later rows can meet, of those *used* just
    now and those from *before*.

    Within a window of a user's last admission there are at most as many as
    their limit, and no older one can matter again.  With *late_us* rows are
    never further than that behind the newest: users of whom all is older than
    that and the window are left out, but the newest stamp of all stays.
    """
    stamps = used if before is None else used.unionByName(before)
    last = stamps.groupBy("quota_key").agg(F.max("us").alias("last_us"))
    alive = stamps.join(last, "quota_key").where(F.col("us") > F.col("last_us") - window_us)
    if late_us is not None:
        newest = stamps.agg(F.max("us")).first()[0]
        alive = alive.where(F.col("us") >= F.lit(newest) - window_us - late_us)
    return alive.select("quota_key", "us")


def active_users(df: DataFrame, user: str = "user_id") -> DataFrame:
    """Users ever seen by the limiter, admitted or not, as one row."""
    who = F.coalesce(F.col(user).cast("string"), F.lit(ANONYMOUS))
    return df.select(who.alias("_user")).distinct().agg(F.count("*").alias("active_users"))
