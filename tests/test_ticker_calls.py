import pandas as pd

from depotlens.streaming import ticker


class Counted:
    """A state store and its timers that note each call."""

    def __init__(self):
        self.calls, self.value = [], None

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def registerTimer(self, at):
        self.calls.append(("timer", at))

    def deleteTimer(self, at):
        self.calls.append(("no timer", at))


class Now:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_calls_do_not_grow_with_ticks():
    """A batch costs a scan one read, one write and one timer, however many ticks it fills."""
    store, t = Counted(), ticker.Ticker(1)
    t.init(store)
    frame = lambda ms, ended: pd.DataFrame({"ms": ms, "listed": 3, "done": 1, "ended": [*[False] * (len(ms) - 1), ended]})
    assert list(t.handleInputRows(("c", 1), iter([frame(list(range(0, 50_000, 500)), False)]), Now(0))) == []
    assert store.calls == ["get", "update", ("timer", 1000)] or store.calls == ["get", ("timer", 1000), "update"]
    store.calls.clear()
    out = pd.concat(t.handleExpiredTimer(("c", 1), Now(20_001), None))
    assert len(out) == 20 and out["processed_count"].tolist() == [3 + 2 * k for k in range(20)] and not out["final"].any()
    assert len(store.calls) == 3
    list(t.handleInputRows(("c", 1), iter([frame([50_000], True)]), Now(20_001)))
    out = pd.concat(t.handleExpiredTimer(("c", 1), Now(60_000), None))
    assert out["elapsed_in_sec"].tolist() == [*range(21, 50), 50] and out["final"].tolist() == [False] * 29 + [True]
    assert out["processed_count"].iloc[-1] == 101 and out["active_count"].iloc[-1] == 202
