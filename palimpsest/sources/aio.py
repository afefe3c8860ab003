"""The store for asyncio: the same calls, each run in a thread of its own."""

from __future__ import annotations

import asyncio
from collections.abc import Callable
from functools import wraps

from pyspark.sql import SparkSession

from palimpsest.config import StoreConfig
from palimpsest.sources.store import MemoryStore, Namespace


class _Threaded:
    """Wraps an object: its methods become coroutines, its other attributes stay."""

    def __init__(self, target: object) -> None:
        self._target = target

    def __getattr__(self, name: str):
        found = getattr(self._target, name)
        if name.startswith("_") or not callable(found):
            return found
        return _in_thread(found)


def _in_thread(call: Callable):
    @wraps(call)
    async def run(*args, **settings):
        return await asyncio.to_thread(call, *args, **settings)

    return run


class AsyncNamespace(_Threaded):
    """Reads and writes of one namespace as coroutines.

    Writers of one store still have to come one after the other: a write that
    another one overtook raises `Busy`, as it does without asyncio.
    """

    def __init__(self, target: Namespace) -> None:
        super().__init__(target)

    async def search(self, build: Callable) -> list:
        """The hits of a search that `build` sets up: it takes a search and returns it."""
        return await asyncio.to_thread(lambda: build(self._target.search()).execute().collect())

    async def rows(self, condition=None) -> list:
        return await asyncio.to_thread(lambda: self._target.iter(condition).collect())


class AsyncStore(_Threaded):
    """A store whose calls are coroutines; namespaces are asynchronous too."""

    def __init__(self, target: MemoryStore) -> None:
        super().__init__(target)

    @classmethod
    async def open(cls, spark: SparkSession, root: str, config: StoreConfig) -> AsyncStore:
        return cls(await asyncio.to_thread(MemoryStore.open, spark, root, config))

    def namespace(self, path: str) -> AsyncNamespace:
        return AsyncNamespace(self._target.namespace(path))
