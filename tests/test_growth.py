"""Work and memory of a task that grow no faster than the input: where rows are dealt out, and how often the state is called."""

import random

import pandas as pd

from oficina.operators import builds, ingest
from oficina.streaming.alerts import Resting


def plan(df):
    """Operators from the result down to the tables, Project left out."""
    lines = [x.strip(" :+-*").split(") ", 1)[-1] if x.strip(" :+-").startswith("*(") else x.strip(" :+-") for x in df._jdf.queryExecution().executedPlan().toString().splitlines()]
    return [x for x in lines if x and not x.startswith(("Project", "AdaptiveSparkPlan"))]


def test_attributes_are_dealt_out_before_they_are_sorted(spark):
    rows = spark.createDataFrame([(p, k, v, s, n) for p in range(20) for n, (k, v, s) in enumerate([("a", "1", "title"), ("a", "2", "page"), ("b", "x", "manual"), ("b", "y", "title"), ("c", " ", "page")])], "product_id long, key string, value_text string, source string, seq int").coalesce(1)
    out = ingest.merge_attributes(rows)
    ops = plan(out)
    first = next(i for i, x in enumerate(ops) if x.startswith("Exchange"))
    assert any("Aggregate" in x for x in ops[:first]) and not any("Aggregate" in x or x.startswith("Sort") for x in ops[first:])
    assert sorted(out.select("product_id", "key", "value_text", "source").collect()) == sorted((p, k, v, s) for p in range(20) for k, v, s in [("a", "2", "page"), ("b", "x", "manual")])


def test_baskets_are_not_gathered_in_the_tasks_that_join(spark):
    items = spark.createDataFrame([(b, p) for b in range(30) for p in (b % 7, b % 7, b % 5, None)], "build_id long, product_id long")
    stores = spark.createDataFrame([(p, s, float(p + 1)) for p in range(6) for s in ("alfa", "beta")], "product_id long, slug string, price double")
    out = builds.baskets(items, stores)
    ops = plan(out)
    dealt = [i for i, x in enumerate(ops) if x.startswith("Exchange") and "build_id" in x]
    assert any("Join" in x for i in dealt for x in ops[i + 1 : i + 3] if "REPARTITION" in ops[i])
    want = []
    for b in range(30):
        mine = [b % 7, b % 7, b % 5]
        known = [p for p in mine if p < 6]
        for s in ("alfa", "beta"):
            if known:
                want.append((b, s, float(sum(p + 1 for p in set(known))), len(known), 3))
    assert sorted(tuple(r) for r in out.select("build_id", "slug", "total", "covered_items", "total_items").collect()) == sorted(want)


class State:
    """The state of one alert; counts its calls."""

    def __init__(self):
        self.calls, self.timers, self.values = 0, set(), {}

    def getValueState(self, name, *schema):
        return Part(self, name)

    getMapState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.discard(at)

    def getCurrentWatermarkInMs(self):
        return self.watermark

    def getExpiryTimeInMs(self):
        return self.now


class Part:
    def __init__(self, state, name):
        self.s, self.n, self.v = state, name, state.values.setdefault(name, {})

    def _called(self):
        self.s.calls += 1

    def exists(self):
        self._called()
        return None in self.v

    def containsKey(self, k):
        self._called()
        return k in self.v

    def getValue(self, k):
        self._called()
        return self.v.get(k)

    def get(self):
        return self.getValue(None)

    def updateValue(self, k, v):
        self._called()
        self.v[k] = v

    def update(self, v):
        self.updateValue(None, v)

    def removeKey(self, k):
        self._called()
        self.v.pop(k, None)

    def clear(self):
        self._called()
        self.v.clear()


def driven(op, batches, state):
    """(price times that fired) of batches of (watermark in ms, parts of rows)."""
    op.init(state)
    fired = []
    for watermark, parts in batches:
        state.watermark = watermark
        if parts:
            list(op.handleInputRows((1,), iter([pd.DataFrame(p, columns=["at_us", "price", "listing_id"]) for p in parts]), state))
        for at in sorted(t for t in state.timers if t <= watermark):
            state.timers.discard(at)
            state.now = at
            for df in op.handleExpiredTimer((1,), state, state):
                fired += list(df[["listing_id", "price", "at_us"]].itertuples(index=False, name=None))
    return fired


def test_state_is_called_by_alert_and_not_by_price():
    minute = 60_000_000
    state = State()
    rows = [(i * 7 * minute, 1.0, 1) for i in range(3000)]
    fired = driven(Resting(24 * 3_600_000, 60_000), [(0, [rows[i::3] for i in range(3)]), (10**10, [])], state)
    assert len(fired) == -(-3000 * 7 // 1442) and state.calls < 60


def test_chunks_of_any_size_fire_like_a_sequence():
    second = 1_000_000
    for seed in range(60):
        rng = random.Random(seed)
        rest, most = rng.choice([60, 600, 3600]), rng.choice([1, 2, 3, 5, 4096])
        rows = [(rng.randrange(0, 20_000) // rng.choice([1, 60]) * second, rng.choice([1.0, 2.0]), rng.randrange(3)) for _ in range(rng.randrange(1, 120))]
        rows.sort(key=lambda r: r[0] + rng.randrange(-300, 300) * second)
        batches, watermark, seen, kept = [], 0, 0, []
        while rows:
            now, rows = rows[: rng.randrange(1, 40)], rows[40:]
            now = [r for r in now if r[0] // 1000 > watermark]
            kept += now
            k = rng.randrange(1, 4)
            batches.append((watermark, [now[i::k] for i in range(k) if now[i::k]]))
            seen = max([seen, *(r[0] // 1000 for r in now)])
            watermark = max(watermark, seen - 900_000)
        batches.append((watermark, []))
        last, want = None, []
        for at, price, listing in sorted(kept):
            if (at // (60 * second) + 1) * 60_000 <= watermark and (last is None or at > last + rest * second):
                want.append((listing, price, at))
                last = at
        state = State()
        op = Resting(rest * 1000, 60_000, most)
        assert driven(op, batches, state) == want
        assert driven(op, [(10**9, []), (2 * 10**9, [])], state) is not None and not state.timers and not any(state.values.values())
