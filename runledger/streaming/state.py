"""Stateful operators on ``transformWithStateInPandas`` (ST3, ST6, ST7, ST8).

A stateful key is a *group* of keys (a hash of the key), so that one call works on the rows of
many jobs or leases as arrays.  What a group still waits for (rows above the
watermark, open holds, running clocks) is one value, written as a small Arrow
table; it is bounded by what is open.  State that is kept for every job for ever
is a map: an entry per job, or in the replay per slot of jobs, and a batch reads and writes only the entries it touches.
Event-time timers wake a group when the watermark reaches what it waits for; a
group that waits for nothing holds no value and no timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from runledger.functions.scalar import epoch_micros, utc_instant
from runledger.operators.lifecycle import step_states
from runledger.schemas import STATES, transition_matrix

#: Groups of keys: fixed when a stream first runs; several per state partition on any cluster of this size.
GROUPS = 64
#: Map entries that hold the jobs of a group in the replay.
SLOTS = 256


def key_group(*keys: str, groups: int = GROUPS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(groups)).alias("_group")


def key_slot(*keys: str, slots: int = SLOTS) -> Column:
    """A part of the key's group (by other bits of the hash)."""
    return F.pmod(F.shiftright(F.xxhash64(*keys), 32), F.lit(slots)).cast("int").alias("slot")


def _packed(df: pd.DataFrame) -> bytes:
    batch = pa.RecordBatch.from_pandas(df, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(raw: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(raw).read_pandas()


class GroupProcessor(StatefulProcessor):
    """Keeps the rows that a group waits for, and one timer at the time it waits for.

    Subclasses give ``advance(held, rows, watermark_ms)``: (rows out, rows to hold, ms at which to wake or None).
    ``held`` is None where nothing is held; ``rows`` is None when a timer woke the group.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "data binary, wake long")
        self.prepare(handle)

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        pass

    def advance(self, held, rows, watermark_ms):
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        yield from self._turn(pd.concat(list(rows), ignore_index=True), timerValues.getCurrentWatermarkInMs(), None)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._turn(None, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def _turn(self, rows, watermark: int, fired: int | None) -> Iterator[pd.DataFrame]:
        held, wake = None, None
        if self.held.exists():
            data, wake = self.held.get()
            held = _unpacked(bytes(data)) if data is not None else None
        out, kept, then = self.advance(held, rows, watermark)
        if then is not None and then == fired:
            then += 1  # the timer that fired is gone
        if wake is not None and wake != then and wake != fired:
            self.handle.deleteTimer(wake)
        if then is not None and (then != wake or wake == fired):
            self.handle.registerTimer(then)
        if kept is not None and len(kept):
            self.held.update((_packed(kept), then))
        elif self.held.exists():
            self.held.clear()
        if out is not None and len(out):
            yield out

    def close(self) -> None:
        pass


def _both(held: pd.DataFrame | None, rows: pd.DataFrame | None) -> pd.DataFrame:
    parts = [p for p in (held, rows) if p is not None]
    return pd.concat(parts, ignore_index=True)


def _codes(*columns: pd.Series) -> np.ndarray:
    """One number per distinct row (nulls equal each other)."""
    out = np.zeros(len(columns[0]), np.int64)
    for c in columns:
        code, names = pd.factorize(c, use_na_sentinel=False)
        out = pd.factorize(out * (len(names) + 1) + code)[0].astype(np.int64)
    return out


def _map_key(job) -> tuple[str]:
    """Null jobs are a job of their own."""
    return ("-",) if job is None or job != job else ("=" + str(job),)


_JOBS = pa.schema([("job", pa.string()), ("cur", pa.int8()), ("applied", pa.int64()), ("rejected", pa.int64())])


class Replay(GroupProcessor):
    """ST3: requests at or below the watermark are applied in ``seq`` order by prefix composition.

    The states of a group's jobs lie in ``SLOTS`` map entries by a hash of the job, each a small Arrow table, so
    the state calls of a batch follow the slots that it touches and not its jobs.
    """

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.jobs = handle.getMapState("jobs", "slot int", "data binary")
        self.index = {s: i for i, s in enumerate(STATES)}
        self.legal = np.array(transition_matrix(), dtype=bool)

    def _known(self, slots: np.ndarray) -> tuple[pd.Index, np.ndarray, np.ndarray]:
        """Names, slots and (state, applied, rejected) of all jobs in these slots."""
        found = [(s, self.jobs.getValue((s,))) for s in slots.tolist()]
        parts = [(s, pa.ipc.open_stream(bytes(v[0])).read_all()) for s, v in found if v is not None]
        table = pa.concat_tables([t for _, t in parts]) if parts else _JOBS.empty_table()
        at = np.repeat([s for s, _ in parts], [len(t) for _, t in parts]).astype(np.int64)
        values = np.stack([table[c].to_numpy().astype(np.int64) for c in ("cur", "applied", "rejected")])
        return pd.Index(table["job"].to_numpy(), dtype=object), at, values

    def _keep(self, names: np.ndarray, slots: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(slots, kind="stable")
        slots, values = slots[order], values[:, order]
        columns = [pa.array(names[order], pa.string()), pa.array(values[0].astype(np.int8)), *map(pa.array, values[1:])]
        table = pa.RecordBatch.from_arrays(columns, schema=_JOBS)
        heads = np.flatnonzero(np.diff(slots, prepend=-1))
        for a, b in zip(heads.tolist(), np.append(heads[1:], len(slots)).tolist(), strict=True):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, _JOBS) as out:
                out.write_batch(table.slice(a, b - a))
            self.jobs.updateValue((int(slots[a]),), (sink.getvalue().to_pybytes(),))

    def advance(self, held, rows, watermark_ms):
        every = _both(held, rows[["job_id", "slot", "seq", "to_state", "ms"]] if rows is not None else None)
        ready = (every["ms"] <= watermark_ms).to_numpy()
        kept = every[~ready]
        wake = None if kept.empty else int(kept["ms"].min())
        now = every[ready].reset_index(drop=True)
        if now.empty:
            return None, kept, wake
        now["_job"] = _codes(now["job_id"])
        now = now.sort_values(["_job", "seq"], kind="stable").reset_index(drop=True)
        job = now["_job"].to_numpy()
        first = np.ones(len(now), bool)
        first[1:] = job[1:] != job[:-1]
        heads = np.flatnonzero(first)
        ends = np.append(heads[1:], len(now)) - 1
        size = ends - heads + 1
        ids = now["job_id"].iloc[heads]
        names = ("=" + ids.astype(object).fillna("")).where(ids.notna(), "-").to_numpy(object)  # null jobs are a job of their own
        slots = now["slot"].to_numpy(np.int64)[heads]
        known, at, values = self._known(np.unique(slots))
        fresh = known.get_indexer(names) < 0
        known = known.append(pd.Index(names[fresh], dtype=object))
        at = np.append(at, slots[fresh])
        values = np.hstack([values, np.zeros((3, int(fresh.sum())), np.int64)])
        place = known.get_indexer(names)
        start = np.repeat(values[0, place], size)
        target = now["to_state"].map(self.index).fillna(-1).to_numpy(np.int64)
        before, accepted, after = step_states(target, first, start, self.legal)
        applied = np.add.reduceat(accepted.astype(np.int64), heads)
        values[0, place] = after[ends]
        values[1, place] += applied
        values[2, place] += size - applied
        self._keep(known.to_numpy(object), at, values)
        out = now[["job_id", "seq", "to_state"]].copy()
        out["from_state"] = np.array(STATES, dtype=object)[before]
        out["accepted"] = accepted
        return out, kept, wake


class StaleAlerts(GroupProcessor):
    """ST7: one alert per gap longer than the bound; a job's clock is held until the watermark passes its bound."""

    def __init__(self, bound_ms: int):
        self.bound = bound_ms

    def advance(self, held, rows, watermark_ms):
        every = _both(held, rows[["job_id", "ms"]] if rows is not None else None)
        every["_job"] = _codes(every["job_id"])
        every = every.sort_values(["_job", "ms"], kind="stable").reset_index(drop=True)
        job, ms = every["_job"].to_numpy(), every["ms"].to_numpy(np.int64)
        last = np.ones(len(ms), bool)
        last[:-1] = job[1:] != job[:-1]
        gap = np.zeros(len(ms), bool)
        gap[:-1] = ~last[:-1] & (ms[1:] - ms[:-1] > self.bound)
        gone = last & (ms + self.bound < watermark_ms)
        alert = every[gap | gone]
        out = pd.DataFrame({"job_id": alert["job_id"], "last_checkpoint_ms": alert["ms"], "stale_since_ms": alert["ms"] + self.bound})
        kept = every.loc[last & ~gone, ["job_id", "ms"]]
        return out, kept, None if kept.empty else int(kept["ms"].min()) + self.bound + 1


class Attempts(GroupProcessor):
    """ST6: numbers lines by the attempt they belong to: the ``started`` lines of the job up to their position.

    A line that is sent again belongs to the attempt of its first sending, since its position says where it stood.
    The state holds the positions of a job's ``started`` lines.
    """

    def prepare(self, handle: StatefulProcessorHandle) -> None:
        self.starts = handle.getMapState("starts", "job string", "seqs array<long>")

    def advance(self, held, rows, watermark_ms):
        job = _codes(rows["job_id"])
        order = np.lexsort((rows["seq"].to_numpy(), job))
        rows, job = rows.iloc[order].reset_index(drop=True), job[order]
        heads = np.flatnonzero(np.diff(job, prepend=-1))
        begun = (rows["type"] == "started").to_numpy()
        seq = rows["seq"].to_numpy(np.int64)
        attempt = np.zeros(len(rows), np.int64)
        for a, b in zip(heads, np.append(heads[1:], len(rows)), strict=True):  # one turn per job
            key = _map_key(rows["job_id"].iloc[a])
            known = np.array((self.starts.getValue(key) or ([],))[0], np.int64)
            fresh = np.setdiff1d(seq[a:b][begun[a:b]], known)
            if len(fresh):
                known = np.union1d(known, fresh)
                self.starts.updateValue(key, (known.tolist(),))
            attempt[a:b] = np.searchsorted(known, seq[a:b], side="right")
        rows["attempt"] = attempt
        points = rows[rows["type"] == "checkpoint"]
        return points[["job_id", "attempt", "epoch", "seq", "ts", "found", "event_time"]], None, None


class HoldEvents(GroupProcessor):
    """ST8, first step: touches below the watermark become holds; each gives a row when it opens and one when it closes."""

    def __init__(self, ttl_seconds: int):
        self.ttl = ttl_seconds * 1_000_000

    def advance(self, held, rows, watermark_ms):
        columns = ["lease_key", "holder", "us", "from_us", "touches"]  # a held hold has from_us, a waiting touch has none
        if rows is not None:
            rows = rows[["lease_key", "holder", "us"]].assign(from_us=pd.array([None] * len(rows), "Int64"), touches=1)
        every = _both(held, rows)
        every["from_us"] = every["from_us"].astype("Int64")
        waits = (every["from_us"].isna() & (every["us"] // 1000 > watermark_ms)).to_numpy()
        wait = every[waits]
        now = every[~waits].reset_index(drop=True)
        now["_who"] = _codes(now["lease_key"], now["holder"]) if len(now) else 0
        now = now.sort_values(["_who", "us"], kind="stable").reset_index(drop=True)
        if now.empty:
            return None, wait[columns], int(wait["us"].min()) // 1000 if len(wait) else None
        who, us = now["_who"].to_numpy(), now["us"].to_numpy(np.int64)
        new = np.ones(len(now), bool)  # a held hold comes first of its holder, its last touch is its place
        new[1:] = (who[1:] != who[:-1]) | (us[1:] - us[:-1] > self.ttl)
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(now)) - 1
        holds = now.iloc[heads][["lease_key", "holder"]].reset_index(drop=True)
        was = now["from_us"].iloc[heads].reset_index(drop=True)
        holds["from_us"] = was.fillna(pd.Series(us[heads])).astype("int64")
        holds["us"] = us[ends]
        holds["touches"] = np.add.reduceat(now["touches"].to_numpy(np.int64), heads)
        followed = np.zeros(len(heads), bool)
        followed[:-1] = who[heads[1:]] == who[heads[:-1]]
        closed = followed | (us[ends] + self.ttl < watermark_ms * 1000)
        opened = holds[was.isna().to_numpy()].assign(last_us=pd.array([None] * int(was.isna().sum()), "Int64"))
        shut = holds[closed].assign(last_us=holds["us"][closed].astype("Int64"))
        out = pd.concat([opened, shut], ignore_index=True)[["lease_key", "holder", "from_us", "last_us", "touches"]]
        running = holds[~closed].astype({"from_us": "Int64"})
        kept = pd.concat([wait[columns], running[columns]], ignore_index=True)
        wakes = [int(us) // 1000 for us in wait["us"].nsmallest(1)]
        wakes += [(int(us) + self.ttl) // 1000 + 1 for us in running["us"].nsmallest(1)]
        return out, kept, min(wakes, default=None)


class Gaps(GroupProcessor):
    """ST8, second step: each closed hold with the next one of its key, as soon as both are known.

    Holds open in the order of their starts (a batch brings all up to its watermark), so the next hold of a key
    is final once there is one.  Held are the open holds and the last one of each key.
    """

    def advance(self, held, rows, watermark_ms):
        rows = rows[["lease_key", "holder", "from_us", "last_us"]].astype({"last_us": "Int64"}).assign(told=False)
        every = _both(held, rows)
        every["last_us"] = every["last_us"].astype("Int64")
        every["_key"] = _codes(every["lease_key"])
        # the closing row of a hold takes the place of its opening row
        every = every.sort_values(["_key", "from_us", "holder", "last_us"], kind="stable", na_position="first")
        every = every.drop_duplicates(["_key", "from_us", "holder"], keep="last").reset_index(drop=True)
        key = every["_key"].to_numpy()
        succeeded = np.zeros(len(every), bool)
        succeeded[:-1] = key[1:] == key[:-1]
        done = succeeded & every["last_us"].notna().to_numpy()
        tell = done & ~every["told"].to_numpy(bool)
        out = every[tell].copy()
        at = np.flatnonzero(tell) + 1
        out["next_holder"] = every["holder"].to_numpy()[at]
        out["next_from_us"] = every["from_us"].to_numpy()[at]
        out = out[out["next_holder"] != out["holder"]]
        # an open hold's successor is needed until it closes, also if it is done itself
        every["told"] = done
        needed = ~done | np.concatenate([[False], ~done[:-1] & succeeded[:-1]])
        kept = every.loc[needed, ["lease_key", "holder", "from_us", "last_us", "told"]]
        return out[["lease_key", "holder", "from_us", "last_us", "next_holder", "next_from_us"]].astype({"last_us": "int64"}), kept, None


def _timed(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn("event_time", utc_instant(ts)).withWatermark("event_time", delay)


def replayed(requests: DataFrame, key: str, seq: str, to: str, ts: str, delay: str, groups: int = GROUPS) -> DataFrame:
    rows = _timed(requests, ts, delay).select(
        key_group(key, groups=groups), key_slot(key), F.col(key).cast("string").alias("job_id"), F.col(seq).cast("bigint").alias("seq"),
        F.col(to).alias("to_state"), F.floor(epoch_micros(ts) / 1000).cast("bigint").alias("ms"), "event_time",
    )
    return rows.groupBy("_group").transformWithStateInPandas(
        Replay(), "job_id string, seq bigint, to_state string, from_state string, accepted boolean", "append", "EventTime"
    )


def stale_alerts(points: DataFrame, bound_seconds: int, key: str, ts: str, delay: str, groups: int = GROUPS) -> DataFrame:
    rows = _timed(points, ts, delay).select(
        key_group(key, groups=groups), F.col(key).cast("string").alias("job_id"),
        F.floor(epoch_micros(ts) / 1000).cast("bigint").alias("ms"), "event_time",
    )
    return rows.groupBy("_group").transformWithStateInPandas(
        StaleAlerts(bound_seconds * 1000), "job_id string, last_checkpoint_ms bigint, stale_since_ms bigint", "append", "EventTime"
    )


def attempt_points(events: DataFrame, ts: str, delay: str, groups: int = GROUPS) -> DataFrame:
    """Checkpoint lines with the attempt that each belongs to, and ``event_time`` with its watermark."""
    rows = _timed(events, ts, delay).select(key_group("job_id", groups=groups), "job_id", "type", "epoch", "seq", F.col(ts).alias("ts"), "found", "event_time")
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in ("job_id", "attempt", "epoch", "seq", "ts", "found", "event_time"))
    return rows.groupBy("_group").transformWithStateInPandas(
        Attempts(), schema, "append", "EventTime", eventTimeColumnName="event_time"
    )


def hold_gaps(touches: DataFrame, ttl_seconds: int, key: str, holder: str, ts: str, delay: str, groups: int = GROUPS) -> DataFrame:
    """(key, holder, from_us, last_us, next_holder, next_from_us) of every hold that another holder's hold follows."""
    kinds = {f.name: f.dataType.simpleString() for f in touches.schema.fields}
    rows = _timed(touches, ts, delay).select(
        key_group(key, holder, groups=groups), F.col(key).alias("lease_key"), F.col(holder).alias("holder"), epoch_micros(ts).alias("us"), "event_time"
    )
    who = f"lease_key {kinds[key]}, holder {kinds[holder]}"
    events = rows.groupBy("_group").transformWithStateInPandas(
        HoldEvents(ttl_seconds), f"{who}, from_us bigint, last_us bigint, touches bigint", "append", "EventTime"
    )
    dealt = events.select(key_group("lease_key", groups=groups), "*")
    return dealt.groupBy("_group").transformWithStateInPandas(
        Gaps(), f"{who}, from_us bigint, last_us bigint, next_holder {kinds[holder]}, next_from_us bigint", "append", "None"
    )
