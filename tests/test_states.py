"""Marks and rates of many keys in one call."""

import numpy as np
import pandas as pd

from runlens.streaming import states


class Handle:
    """The states of one bucket as a dictionary."""

    def __init__(self):
        self.stored = {}

    def getMapState(self, name, key, value, ttl):
        return self

    def getValue(self, key):
        return self.stored.get(key)

    def updateValue(self, key, value):
        self.stored[key] = value


def run(processor, triggers):
    handle = Handle()
    processor.init(handle)
    return [pd.concat(processor.handleInputRows(("bucket",), iter([t.iloc[:3], t.iloc[3:]]), None)) for t in triggers]


def test_marks_of_many_keys_in_one_call():
    rng, keys = np.random.RandomState(3), list("abcd")
    triggers = [pd.DataFrame({"c0": np.arange(200) + 200 * n, "key": rng.choice(keys[:3 + n], 200), "at": rng.randint(0, 900, 200),
                              "setter": rng.randint(0, 2, 200), "arrived": rng.randint(0, 40, 200)}) for n in range(2)]
    triggers[0].loc[::17, "at"] = states.NONE
    triggers[0].loc[::17, "setter"] = 0
    found = run(states.NewerSamples(["id"]), triggers)
    marks = {}
    for rows, kept in zip(triggers, found):
        want, after = set(), dict(marks)
        for r in rows.itertuples():
            earlier = rows[(rows["key"] == r.key) & (rows["setter"] == 1) & (rows["arrived"] < r.arrived)]["at"].tolist()
            seen = max([*earlier, marks.get(r.key, states.NONE)])
            if r.at > seen or seen == states.NONE:
                want.add(r.c0)
            if r.setter:
                after[r.key] = max(after.get(r.key, states.NONE), r.at)
        marks = after
        assert set(kept["id"]) == want and len(kept) == len(want)


def test_rates_of_many_keys_in_one_call():
    rng, keys = np.random.RandomState(4), list("abcd")
    triggers = [pd.DataFrame({"c0": np.arange(200) + 200 * n, "key": rng.choice(keys[:3 + n], 200), "t": rng.randint(0, 60, 200) * 500 + 20_000 * n,
                              "id": np.arange(200) + 200 * n, "v": rng.rand(200).round(3), "kind": rng.randint(-1, 2, 200)}) for n in range(2)]
    found = run(states.Rates(["id"]), triggers)
    lasts, some_late = {}, 0
    for rows, made in zip(triggers, found):
        got = {r.id: (r.rate, r.late) for r in made.itertuples()}
        assert len(got) == len(made) == len(rows)
        known = dict(lasts)
        for r in rows.sort_values(["t", "id"]).itertuples():
            if r.key in known and (r.t, r.id) <= known[r.key][:2]:
                some_late += 1
                assert got[r.c0][1] and np.isnan(got[r.c0][0])
                continue
            t, _, v, kind = lasts.get(r.key, (r.t, r.id, r.v, r.kind))
            rate = 1000.0 * max(0.0, r.v - v) / max(1.0, (r.t - t) / 1000.0) if kind == 1 else r.v
            assert got[r.c0] == (rate, False)
            lasts[r.key] = (r.t, r.id, r.v, kind)
    assert some_late


def test_keys_keep_nulls_and_parts_apart(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "2"), (12, ""), (None, "a"), (None, None), (1, None), (1, "null"), (1, "2")], "a long, b string")
    out = states._keyed(rows, [F.col("a"), F.col("b")], 64, x=F.lit(1)).collect()
    assert len({r["key"] for r in out}) == 6 and out[0]["bucket"] == out[-1]["bucket"] and all(0 <= r["bucket"] < 64 for r in out)
