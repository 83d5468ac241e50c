"""Aids for kernels: counting calls, timing them, and looking at a value before it is stored."""

from __future__ import annotations

import functools
import logging
import time
from collections.abc import Callable

LOG = logging.getLogger("strandline")


def count_calls(most: int | None = None):
    """Counts a function's calls in its attribute ``calls``; beyond ``most`` it raises."""

    def wrap(f: Callable):
        @functools.wraps(f)
        def run(*args, **kw):
            run.calls += 1
            if most is not None and run.calls > most:
                raise RuntimeError(f"{f.__name__} was called more than {most} times")
            return f(*args, **kw)

        run.calls = 0
        return run

    return wrap


def timed(f: Callable):
    """Adds up a function's seconds and calls in its attributes."""

    @functools.wraps(f)
    def run(*args, **kw):
        began = time.perf_counter()
        try:
            return f(*args, **kw)
        finally:
            run.seconds += time.perf_counter() - began
            run.calls += 1

    run.seconds, run.calls = 0.0, 0
    return run


class Timer:
    """with Timer('what') as t: ...; t.seconds, logged on leaving."""

    def __init__(self, what: str = ""):
        self.what, self.seconds = what, 0.0

    def __enter__(self) -> Timer:
        self._began = time.perf_counter()
        return self

    def __exit__(self, *_) -> None:
        self.seconds = time.perf_counter() - self._began
        LOG.debug("%s: %.3f s", self.what, self.seconds)


def watch_values(look: Callable[[object], None], most: int | None = None):
    """Shows each value a function returns to ``look``, the first ``most`` of them."""

    def wrap(f: Callable):
        @functools.wraps(f)
        def run(*args, **kw):
            out = f(*args, **kw)
            if most is None or run.seen < most:
                run.seen += 1
                look(out)
            return out

        run.seen = 0
        return run

    return wrap
