"""Named things that can be added from outside: loaders, parsers, chunkers, cleaners, retrievers, embedders, stores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Generic, TypeVar

from pyspark.sql import DataFrame

T = TypeVar("T")


class Registry(Generic[T]):
    """Names with values; a name is taken once unless it is overridden."""

    def __init__(self, kind: str) -> None:
        self.kind, self._held = kind, {}

    def register(self, name: str, value: T | None = None, override: bool = False) -> T | Callable[[T], T]:
        """Adds a value, or as a decorator the function below it."""

        def keep(v: T) -> T:
            if name.lower() in self._held and not override:
                raise ValueError(f"{self.kind} {name!r} is registered already")
            self._held[name.lower()] = v
            return v

        return keep if value is None else keep(value)

    def get(self, name: str) -> T:
        if name.lower() not in self._held:
            raise KeyError(f"no {self.kind} {name!r}; there are {', '.join(self) or 'none'}")
        return self._held[name.lower()]

    def __iter__(self) -> Iterator[str]:
        return iter(sorted(self._held))

    def __contains__(self, name: str) -> bool:
        return name.lower() in self._held


loaders: Registry[Callable] = Registry("loader")
parsers: Registry[Callable] = Registry("parser")
chunkers: Registry[Callable] = Registry("chunker")
cleaners: Registry[Callable[[DataFrame], DataFrame]] = Registry("cleaner")
retrievers: Registry[Callable] = Registry("retriever")
embedders: Registry[Callable] = Registry("embedder")
stores: Registry[Callable] = Registry("store")


def apply_cleaners(rows: DataFrame, *names: str) -> DataFrame:
    """The named stages, one after another."""
    for name in names:
        rows = rows.transform(cleaners.get(name))
    return rows
