"""Time-derived measurements on a stream: state by buckets of subjects, rows once the watermark has passed their event."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from eventspark.functions.units import time_unit
from eventspark.operators.timeline import birth_rows, hours_of

_OUT = "subject_id long, time timestamp, code string, numeric_value float"


@dataclass
class Derived:
    """What is derived, as plain values that go to the tasks."""

    age: tuple[str, float] | None = None  # code, seconds of the unit
    day: list[tuple[int, int, str]] = field(default_factory=list)  # from hour, to hour, code
    start: str | None = None
    delta: tuple[str, float] | None = None
    end: str | None = None
    end_after: int = 0  # microseconds

    @classmethod
    def of(cls, features: dict[str, Any], end_after: int) -> Derived:
        out = cls(end_after=end_after)
        if (cfg := features.get("age")) is not None:
            out.age = (cfg.get("age_code", "AGE"), time_unit(cfg.get("age_unit", "y"))[1])
        if (cfg := features.get("time_of_day")) is not None:
            out.day = [(lo, hi, f"{cfg['time_of_day_code']}//[{lo:02},{hi:02})") for lo, hi in hours_of(cfg.get("endpoints"))]
        if (cfg := features.get("timeline_tokens")) is not None:
            out.start, out.end = cfg.get("timeline_start_code", "TIMELINE//START"), cfg.get("timeline_end_code", "TIMELINE//END")
            if (delta := cfg.get("time_delta_code", "TIMELINE//DELTA//{time_unit}")) is not None:
                unit, seconds = time_unit(cfg["time_unit"])
                out.delta = (delta.format(time_unit=unit), seconds)
        return out

    def rows(self, events: np.ndarray, before: np.ndarray, births: np.ndarray) -> list[pd.DataFrame]:
        """Rows of ``events`` (subject, time), given the event before each (``NEVER``: none) and all births so far."""
        at, out = events[:, 1], []
        if self.age:
            both = pd.DataFrame(events, columns=["subject", "at"]).merge(pd.DataFrame(births, columns=["subject", "born"]), on="subject")
            value = ((both["at"] - both["born"]) / (1e6 * self.age[1])).to_numpy("float32")
            out.append(made(both[["subject", "at"]].to_numpy()[value > 0], self.age[0], value[value > 0]))
        hour = at // 3_600_000_000 % 24
        out += [made(events[(lo <= hour) & (hour < hi)], code) for lo, hi, code in self.day]
        first = before == NEVER
        if self.start is not None:
            out.append(made(events[first], self.start))
        if self.delta:
            out.append(made(events[~first], self.delta[0], (at[~first] - before[~first]) / (1e6 * self.delta[1])))
        return out


#: Time of an event that is not.
NEVER = np.iinfo(np.int64).min
#: State of a bucket of subjects, as bytes of whole numbers: event times that the watermark hasn't passed (subject, time),
#: birth times (subject, time), and the last event that it has passed, with whether an end was given for that one (subject,
#: time, 0 or 1), by subject.
_STATE, _WIDTHS = "waiting binary, births binary, done binary", (2, 2, 3)


def made(events: np.ndarray, code: str, value: np.ndarray | None = None) -> pd.DataFrame:
    value = np.full(len(events), np.nan) if value is None else value
    return pd.DataFrame({"subject_id": events[:, 0], "time": pd.to_datetime(events[:, 1], unit="us"), "code": code, "numeric_value": pd.array(value, "Float32")})


def _last_of(done: np.ndarray, subjects: np.ndarray) -> np.ndarray:
    at = np.searchsorted(done[:, 0], subjects)
    there = np.append(done[:, 0], 0)[at] == subjects
    return np.where(there & (at < len(done)), np.append(done[:, 1], 0)[at], NEVER)


def advanced(derived: Derived) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Takes up the new rows of a bucket of subjects and gives what the watermark lets be told. A bucket is called once in
    a micro-batch, for its rows or because the time of one of its subjects has come, and does all of them together; no
    event or subject costs a call of its own."""

    def of_bucket(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = state.get if state.exists else (b"", b"", b"")
        waiting, births, done = (np.frombuffer(x, np.int64).reshape(-1, n) for x, n in zip(kept, _WIDTHS, strict=True))
        now = state.getCurrentWatermarkMs() * 1000
        for pdf in rows:
            new = pdf[["subject_id", "us"]].to_numpy(np.int64)
            births = np.vstack([births, new[pdf["born"].to_numpy(bool)]])
            waiting = np.vstack([waiting, new[new[:, 1] > _last_of(done, new[:, 0])]])
        waiting = np.unique(waiting, axis=0)  # by subject and time
        due = waiting[:, 1] <= now
        ready, waiting = waiting[due], waiting[~due]
        other = ready[1:, 0] != ready[:-1, 0]
        first, last = np.append(True, other)[: len(ready)], np.append(other, True)[: len(ready)]
        before = np.where(first, _last_of(done, ready[:, 0]), np.roll(ready[:, 1], 1))
        out = derived.rows(ready, before, births)

        newest = np.column_stack([ready[last], np.zeros(last.sum(), np.int64)])
        done = np.vstack([done[~np.isin(done[:, 0], newest[:, 0])], newest])
        done = done[np.argsort(done[:, 0])]
        going = (done[:, 2] == 0) & ~np.isin(done[:, 0], waiting[:, 0])
        ends = going & (done[:, 1] + derived.end_after <= now)
        done[ends, 2] = 1
        if derived.end is not None:
            out.append(made(done[ends, :2], derived.end))
        state.update((waiting.tobytes(), births.tobytes(), done.tobytes()))
        if len(next_ := np.append(waiting[:, 1], done[going & ~ends, 1] + derived.end_after)):
            # Time is up once the watermark is past the millisecond before.
            state.setTimeoutTimestamp(max(-(-int(next_.min()) // 1000) - 1, 1))
        if out := [x for x in out if len(x)]:
            yield pd.concat(out, ignore_index=True)

    return of_bucket


def time_derived_stream(stream: DataFrame, features: dict[str, Any], late: str = "1 day", end_after: str = "365 days", buckets: int = 1024) -> DataFrame:
    """The rows that ``add_time_derived_measurements`` adds, for a stream of (subject_id, time, code, ...).

    Rows may come in any order, up to ``late`` behind the latest time seen. An event's rows are given once the watermark
    has passed it, so that no earlier event of its subject can still come; a birth is earlier than the events that have a
    positive age by it, so ages are whole then too. A timeline's end is given once the watermark is ``end_after`` past the
    subject's last event, and no later event has come; should one come after that, the timeline goes on from there, and
    ends again. With no such gap the rows are those of the batch stage over all rows that weren't too late.

    Rows without a subject or a time make no events. State is each subject's pending event times, its births and its last
    event, kept for ``buckets`` of subjects together; take as many as leave some thousands of subjects in a bucket, and
    the same number for all runs of a stream. Times of day are those of UTC. State lives in RocksDB, which this sets for
    the session, rather than in the executors' heaps.
    """
    from pyspark.errors import PySparkValueError

    spark, key = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(key, ""):
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    length = spark.sql(f"SELECT unix_micros(timestamp'1970-01-01 00:00:00Z' + interval {end_after})").first()[0]
    derived = Derived.of(features, length)
    if unknown := set(features) - {"age", "time_of_day", "timeline_tokens"}:
        raise PySparkValueError(f"Unknown time-derived measurement: {sorted(unknown)}")
    born = birth_rows(features["age"]) if derived.age else F.lit(False)
    rows = stream.where("subject_id is not null and time is not null").withWatermark("time", late)
    rows = rows.select(F.pmod(F.xxhash64("subject_id"), F.lit(buckets)).alias("bucket"), "subject_id", "time", F.unix_micros("time").alias("us"), F.coalesce(born, F.lit(False)).alias("born"))
    return rows.groupBy("bucket").applyInPandasWithState(advanced(derived), _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
