"""A1-A4 on the driver: the totals of a crawl, one number for each key; what is counted is counted by jobs."""

from __future__ import annotations


class Stats:
    def __init__(self):
        self._values: dict[str, object] = {}

    def inc(self, key: str, n: float = 1, start: float = 0) -> None:
        self._values[key] = self._number(key, start) + n

    def maximum(self, key: str, value) -> None:
        """compared as numbers; what is no number counts as 0."""
        self._values[key] = max(self._number(key, value), value)

    def minimum(self, key: str, value) -> None:
        self._values[key] = min(self._number(key, value), value)

    def _number(self, key: str, start):
        x = self._values.get(key, start)
        return x if isinstance(x, (int, float)) and not isinstance(x, bool) else 0

    def set(self, key: str, value) -> None:
        self._values[key] = value

    def get(self, key: str, default=None):
        return self._values.get(key, default)

    def all(self) -> dict[str, object]:
        """In the order of keys."""
        return dict(sorted(self._values.items()))

    def clear(self) -> None:
        self._values.clear()
