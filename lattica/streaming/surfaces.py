"""The blocking calls of a session as futures and as coroutines.

Every call is a Spark job of its own; with the FAIR scheduler jobs of several
calls share the executors.  Neither surface closes what it wraps.
"""

from __future__ import annotations

import asyncio
from collections.abc import AsyncIterator, Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import TYPE_CHECKING, Any, TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, Row

if TYPE_CHECKING:
    from lattica.catalog import GraphSession
    from lattica.graph import Graph

T = TypeVar("T")


class FutureSurface:
    """``FutureSurface(session).neighbors(...)`` gives a Future of what the session's call gives."""

    def __init__(self, target: Any, workers: int = 8):
        self._target, self._pool = target, ThreadPoolExecutor(workers, thread_name_prefix="lattica")

    def __getattr__(self, name: str):
        call = getattr(self._target, name)
        if not callable(call):
            return call

        def submit(*args, **kwargs) -> Future:
            return self._pool.submit(inheritable_thread_target(self._target.spark)(call) if hasattr(self._target, "spark") else call, *args, **kwargs)

        return submit

    def close(self) -> None:
        self._pool.shutdown()


class AsyncSurface:
    """``await AsyncSurface(session).neighbors(...)``; collections also as cold streams by :meth:`stream`."""

    def __init__(self, target: Any):
        self._target = target

    def __getattr__(self, name: str):
        call = getattr(self._target, name)
        if not callable(call):
            return call

        async def run(*args, **kwargs):
            return await asyncio.to_thread(call, *args, **kwargs)

        return run

    @staticmethod
    async def stream(frame: DataFrame) -> AsyncIterator[Row]:
        """Rows one by one, a partition ahead; nothing runs before the first is asked for."""
        rows = await asyncio.to_thread(frame.toLocalIterator, True)
        end = object()
        while (row := await asyncio.to_thread(next, rows, end)) is not end:
            yield row


class RawSession:
    """Transactions of the caller's own making on a session's graph, and raw SQL over its views, as coroutines.

    Readers work on the snapshot they began with.  Writers come one after
    another; a write that fails leaves the graph as it was.
    """

    def __init__(self, session: GraphSession):
        self._session, self._turn = session, asyncio.Lock()

    async def read(self, work: Callable[[Graph], T]) -> T:
        """What ``work`` makes of the present snapshot."""
        return await asyncio.to_thread(work, self._session.graph)

    async def write(self, work: Callable[[Graph], Graph]) -> Graph:
        """Replace the graph by what ``work`` makes of it."""
        async with self._turn:
            self._session.graph = await asyncio.to_thread(work, self._session.graph)
            return self._session.graph

    async def rows(self, text: str) -> AsyncIterator[Row]:
        """Rows of SQL over the views ``vertices`` and ``edges``, a partition ahead."""
        frame = await asyncio.to_thread(self._session.sql, text)
        async for row in AsyncSurface.stream(frame):
            yield row

    async def one(self, text: str) -> Row | None:
        """The only row of SQL, None if there is none; ValueError if there are more."""
        found = [row async for row in self.rows(f"SELECT * FROM ({text}) LIMIT 2")]
        if len(found) > 1:
            raise ValueError("more than one row")
        return found[0] if found else None
