"""Marks and rates with one state row per key in Spark's state store.

A trigger reads and writes the states of the keys that it brings, however many there are; the store keeps the others outside
the heap and recovers them with the checkpoint. Keys are dealt into ``buckets``, whose rows within a trigger are ordered
together in one call, so limit what a trigger takes in (``maxFilesPerTrigger``, ``maxBytesPerTrigger``). The number of buckets
stays with a checkpoint. Outputs are streams for any sink.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BooleanType, DoubleType, StructType

from runlens.functions.scalars import numbers
from runlens.operators.scan import micros
from runlens.operators.series import SHARED_MARK

# A call costs the same however few rows it gets, so there are far fewer calls than keys.
BUCKETS = 2_048
NONE = int(np.iinfo(np.int64).min)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _numbered(samples: DataFrame) -> DataFrame:
    """The columns as c0, c1, ...: names that begin with an underscore do not reach a processor."""
    return samples.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(samples.columns)])


def _named(frame: pd.DataFrame, columns: list) -> pd.DataFrame:
    return frame[[f"c{i}" for i in range(len(columns))]].set_axis(columns, axis=1)


def _keyed(samples: DataFrame, keys, buckets: int, **columns) -> DataFrame:
    """``samples`` by number with ``columns``, ``key`` (the values of ``keys`` as text) and ``bucket``."""
    key = F.to_json(F.array(*[k.cast("string") for k in keys]))
    extra = {**columns, "key": key, "bucket": F.pmod(F.xxhash64(key), F.lit(buckets))}
    rows = _numbered(samples.withColumns({f"_{name}": column for name, column in extra.items()}))
    return rows.withColumnsRenamed({f"c{len(samples.columns) + i}": name for i, name in enumerate(extra)})


def _stateful(rows: DataFrame, processor: StatefulProcessor, schema: StructType, ttl: int) -> DataFrame:
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "ProcessingTime" if ttl else "None")


def _firsts(groups: np.ndarray) -> np.ndarray:
    """Where a group begins, in rows that are sorted by group."""
    return np.concatenate([[True], groups[1:] != groups[:-1]])


class NewerSamples(StatefulProcessor):
    """Keeps the newest date of every key of a bucket; ``at`` and ``setter`` (whether a sample moves the mark) are microseconds
    and 0 or 1."""

    def __init__(self, columns: list, ttl: int = None):
        self.columns, self.ttl = columns, ttl

    def init(self, handle) -> None:
        self.marks = handle.getMapState("marks", "key string", "newest bigint", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        codes, keys = pd.factorize(frame["key"])
        marks = [self.marks.getValue((k,)) for k in keys]
        known = np.array([NONE if m is None else m[0] for m in marks], np.int64)
        order = np.lexsort((frame["arrived"].to_numpy(np.int64), codes))
        frame, codes = frame.iloc[order], codes[order]
        at, arrived = frame["at"].to_numpy(np.int64), frame["arrived"].to_numpy(np.int64)
        # The newest date of each arrival, and of all before it.
        first = _firsts(codes) | _firsts(arrived)
        newest = np.maximum.reduceat(np.where(frame["setter"].to_numpy() == 1, at, NONE), np.flatnonzero(first))
        owner = codes[first]
        begins = _firsts(owner)
        # Dates as places among all dates, lifted by key: one running maximum serves all keys.
        dates, place = np.unique(newest, return_inverse=True)
        lift = owner * len(dates)
        so_far = dates[np.maximum.accumulate(place + lift) - lift]
        seen = np.maximum(np.where(begins, NONE, np.roll(so_far, 1)), known[owner])
        last = np.flatnonzero(np.roll(begins, -1))
        for code, date in zip(owner[last].tolist(), so_far[last].tolist()):
            if date != NONE:
                self.marks.updateValue((keys[code],), (max(date, int(known[code])),))
        before = seen[np.cumsum(first) - 1]
        yield _named(frame[(at > before) | (before == NONE)], self.columns)

    def close(self) -> None:
        pass


def newer_samples(samples: DataFrame, arrival: str, entity=("pod_id",), shared=SHARED_MARK, ttl: int = None,
                  buckets: int = BUCKETS) -> DataFrame:
    """The stream of samples newer than all that arrived before for their (entity, metric), as ``series.accept_newer``.

    Samples of one arrival are judged together; those of an earlier trigger have all arrived before. ``ttl``, in
    milliseconds of processing time, forgets marks that long untouched.
    """
    pairs = F.create_map(*[F.lit(x) for pair in shared.items() for x in pair]) if shared else None
    owner = F.coalesce(F.try_element_at(pairs, F.col("name")), F.col("name")) if shared else F.col("name")
    sets = (F.col("name") == owner) & F.col("date").isNotNull() & F.col(arrival).isNotNull()
    rows = _keyed(samples, [*map(F.col, entity), owner], buckets, at=F.coalesce(micros("date"), F.lit(NONE)),
                  setter=F.coalesce(sets.cast("int"), F.lit(0)),
                  arrived=F.coalesce(F.col(arrival).cast("bigint"), F.lit((1 << 63) - 1)))
    return _stateful(rows, NewerSamples(samples.columns, ttl), samples.schema, ttl)


class Rates(StatefulProcessor):
    """Keeps the last sample of every key of a bucket and its kind of series; ``t`` is microseconds, ``v`` the value as a number,
    ``kind`` 1 for counters, 0 for others, -1 if unknown."""

    def __init__(self, columns: list, ttl: int = None):
        self.columns, self.ttl = columns, ttl

    def init(self, handle) -> None:
        self.last = handle.getMapState("last", "key string", "t bigint, id bigint, v double, kind int", self.ttl)

    def handleInputRows(self, key, rows, timerValues):
        frame = pd.concat(list(rows), ignore_index=True)
        codes, keys = pd.factorize(frame["key"])
        order = np.lexsort((frame["id"].to_numpy(np.int64), frame["t"].to_numpy(np.int64), codes))
        frame, codes = frame.iloc[order].reset_index(drop=True), codes[order]
        t, ids, v, kind = (frame[c].to_numpy(d) for c, d in (("t", np.int64), ("id", np.int64), ("v", np.float64), ("kind", np.int64)))
        lasts = [self.last.getValue((k,)) for k in keys]
        old = np.array([x is not None for x in lasts])
        old_t, old_id, old_kind = (np.array([0 if x is None else x[i] for x in lasts], np.int64) for i in (0, 1, 3))
        old_v = np.array([np.nan if x is None or x[2] is None else x[2] for x in lasts], np.float64)
        late = old[codes] & ((t < old_t[codes]) | (t == old_t[codes]) & (ids <= old_id[codes]))
        rate, fresh = np.full(len(frame), np.nan), np.flatnonzero(~late)
        if len(fresh):
            of, here_t, here_v = codes[fresh], t[fresh], v[fresh]
            begins = _firsts(of)
            start = np.flatnonzero(begins)
            known = old[of[start]]
            before_t, before_v = np.roll(here_t, 1), np.roll(here_v, 1)
            before_t[start] = np.where(known, old_t[of[start]], here_t[start])
            before_v[start] = np.where(known, old_v[of[start]], here_v[start])
            kinds = np.where(known, old_kind[of[start]], kind[fresh[start]])
            step = np.maximum(1.0, (here_t - before_t) / 1000.0)
            gain = 1000.0 * np.maximum(0.0, here_v - before_v) / step
            rate[fresh] = np.where(kinds[np.cumsum(begins) - 1] == 1, gain, here_v)
            end = fresh[np.roll(begins, -1)]
            for code, *state in zip(codes[end].tolist(), t[end].tolist(), ids[end].tolist(), v[end].tolist(), kinds.tolist()):
                self.last.updateValue((keys[code],), tuple(state))
        yield _named(frame, self.columns).assign(rate=rate, late=late)

    def close(self) -> None:
        pass


def rates(samples: DataFrame, keys=("pod_id", "name"), ttl: int = None, buckets: int = BUCKETS) -> DataFrame:
    """The stream of samples with ``rate``, as ``series.counter_rate``, and ``late``.

    Samples are ordered by date and metric_id; one that is not after the last sample of an earlier trigger is late and has
    no rate (NaN). Samples without a date or a metric_id have no place and are left out. ``ttl`` as in ``newer_samples``.
    """
    placed = samples.filter("date is not null and metric_id is not null")
    rows = _keyed(placed, map(F.col, keys), buckets, t=micros("date"), v=numbers(samples, "value"), id=F.col("metric_id"),
                  kind=F.coalesce(F.col("cumulative").cast("int"), F.lit(-1)))
    schema = StructType([*samples.schema.fields]).add("rate", DoubleType()).add("late", BooleanType())
    return _stateful(rows, Rates(samples.columns, ttl), schema, ttl)


def start_table(rows: DataFrame, out: str, checkpoint: str, trigger: dict = None) -> StreamingQuery:
    """Write a stream to a table; its log of finished triggers makes every row appear once."""
    return (rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start())
