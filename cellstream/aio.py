"""Asynchronous terminals: any action as an operation that runs in the background."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from typing import Any

from pyspark import InheritableThread  # noqa: F401  (job groups follow the caller's)

_POOL = ThreadPoolExecutor(max_workers=8, thread_name_prefix="cellstream")


class AsyncStream:
    """Mirrors a stream: intermediate operations give another one, terminal ones a Future."""

    def __init__(self, stream: Any):
        self._stream = stream

    def __getattr__(self, name: str) -> Callable[..., Any]:
        method = getattr(self._stream, name)

        def call(*args, **kwargs):
            if name in INTERMEDIATE:
                return AsyncStream(method(*args, **kwargs))
            return submit(method, *args, **kwargs)

        return call


INTERMEDIATE = {
    "filter", "map", "map_to", "map_to_int", "map_to_long", "map_to_double", "flat_map", "distinct", "sorted", "limit", "skip", "peek", "as_long_stream", "as_double_stream", "boxed",
    "unordered", "parallel", "sequential", "batch", "inline", "on_close", "explain", "log", "self_close",
}


def submit(function: Callable[..., Any], *args, **kwargs) -> Future:
    return _POOL.submit(function, *args, **kwargs)
