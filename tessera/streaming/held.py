"""Keyed state of a stream behind one small interface, so that rules run alike over the state store and over a dict."""

from __future__ import annotations

from typing import Any

from pyspark.sql.streaming.stateful_processor import MapState


class Plain:
    """Entries by key, in memory: for replays and tests."""

    def __init__(self) -> None:
        self.entries: dict[str, tuple] = {}

    def get(self, key: str) -> tuple | None:
        return self.entries.get(key)

    def put(self, key: str, value: tuple) -> None:
        self.entries[key] = value

    def drop(self, key: str) -> None:
        self.entries.pop(key, None)

    def keys(self) -> list[str]:
        return list(self.entries)


class InState(Plain):
    """Entries of a map state: read once a micro-batch, and only those that changed are written, at its end."""

    def __init__(self, state: MapState) -> None:
        super().__init__()
        self.state, self.changed = state, set[str]()
        for key, value in state.iterator() if state.exists() else ():
            self.entries[key[0]] = tuple(value)

    def put(self, key: str, value: tuple) -> None:
        super().put(key, value)
        self.changed.add(key)

    def drop(self, key: str) -> None:
        super().drop(key)
        self.changed.add(key)

    def write(self) -> None:
        for key in sorted(self.changed):
            if key in self.entries:
                self.state.updateValue((key,), self.entries[key])
            elif self.state.containsKey((key,)):
                self.state.removeKey((key,))
        self.changed.clear()


def lists(vectors: Any) -> list[list[float]]:
    return [[float(x) for x in v] for v in vectors]
