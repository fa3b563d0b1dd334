"""Waiting events are few entries of state, and told twice they count once."""

from corpusloom.streaming.claims import Claims


class _State(dict):
    """Stands for a map or a value of state; counts writes."""

    writes, n = 0, None

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value

    def iterator(self):
        return iter(list(self.items()))

    def containsKey(self, key):
        return key in self

    def removeKey(self, key):
        self.writes += 1
        del self[key]

    def exists(self):
        return self.n is not None

    def get(self):
        return self.n

    def update(self, value):
        self.n = value

    def clear(self):
        dict.clear(self)
        self.n = None


class _Handle:
    def __init__(self):
        self.states = {}

    def getMapState(self, name, *_):
        return self.states.setdefault(name, _State())

    getValueState = getMapState

    def registerTimer(self, at):
        pass


class _Clock:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_events_wait_in_blocks():
    claims, handle = Claims(2, 3, None), _Handle()
    claims.init(handle)
    rows = [{"kind": "enqueue", "job": str(i), "at_us": i * 1000, "seq": i, "message": None} for i in range(2500)]
    rows += [{"kind": "turn", "job": None, "at_us": 1_000_500, "seq": 9, "message": m} for m in ("first", "second")]
    list(claims.handleInputRows(("q",), iter(rows), _Clock(0)))
    assert handle.states["waiting"].writes == 3
    out = list(claims.handleExpiredTimer(("q",), _Clock(1500), None))
    taken = [(r["job"], r["worker"]) for r in out if r["status"] == "running"]
    assert taken == [("0", "second"), ("1", "second")] and len(out) == 1501 + 2
    out = list(claims.handleExpiredTimer(("q",), _Clock(9000), None))
    assert len(out) == 999 and not handle.states["waiting"]
