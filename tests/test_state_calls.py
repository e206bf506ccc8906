"""Trips to the state store: one look and one write for a unit of a batch, no look for a new session."""

from types import SimpleNamespace

from spanview.streaming.units import _Units


class Map(dict):
    def __init__(self):
        super().__init__()
        self.calls = []

    def exists(self):
        return bool(self)

    def containsKey(self, key):  # noqa: N802
        self.calls.append("has")
        return key in self

    def getValue(self, key):  # noqa: N802
        self.calls.append("get")
        return self[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls.append("put")
        self[key] = value


def test_one_trip_a_unit():
    units = _Units(0)
    units.units = Map()
    rows = [SimpleNamespace(unit_id=f"u{i % 3}", path="p", revision=f"r{i // 6}", turn=i, seq=i, pinned=i == 4) for i in range(30)]
    first = list(units.handleInputRows(("s",), iter(rows[:15]), None))
    assert sorted(units.units.calls) == ["put"] * 3
    second = list(units.handleInputRows(("s",), iter(rows[15:]), None))
    assert sorted(units.units.calls[3:]) == ["get"] * 3 + ["has"] * 3 + ["put"] * 3
    again = list(units.handleInputRows(("s",), iter(rows[20:]), None))
    assert units.units.calls.count("put") == 6 and len(again) == 10
    assert [(x.seq, x.change_count, x.changed_at, x.pinned) for x in (first + second)[-3:]] == [(27, 4, 24, False), (28, 4, 25, True), (29, 4, 26, False)]
