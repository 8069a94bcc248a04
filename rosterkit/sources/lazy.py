"""A table map that builds each DataFrame on first use.

Building a DataFrame costs driver-side analysis; a query that touches
three tables should not pay for fourteen.  ``replace`` gives a new map
with some tables swapped (the version a write job returns) while the
untouched ones stay shared and unbuilt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame


class LazyTables(Mapping):
    def __init__(self, builders: Mapping[str, Callable[[], DataFrame]],
                 cache: dict[str, DataFrame] | None = None,
                 overrides: Mapping[str, DataFrame] | None = None):
        self._builders = dict(builders)
        self._cache = cache if cache is not None else {}
        self._overrides = dict(overrides or {})

    def __getitem__(self, name: str) -> DataFrame:
        if name in self._overrides:
            return self._overrides[name]
        if name not in self._cache:
            if name not in self._builders:
                raise KeyError(name)
            self._cache[name] = self._builders[name]()
        return self._cache[name]

    def __contains__(self, name) -> bool:
        return name in self._overrides or name in self._builders

    def __iter__(self) -> Iterator[str]:
        seen = dict.fromkeys(self._builders)
        seen.update(dict.fromkeys(self._overrides))
        return iter(seen)

    def __len__(self) -> int:
        return len(set(self._builders) | set(self._overrides))

    def replace(self, **changed: DataFrame) -> "LazyTables":
        over = dict(self._overrides)
        over.update(changed)
        return LazyTables(self._builders, self._cache, over)
