"""Seconds of an operation's stages on the driver."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager


class Stages:
    """with stages("name"): ...; seconds holds each stage's time in order, repeated stages summed."""

    def __init__(self):
        self.seconds: dict[str, float] = {}

    @contextmanager
    def __call__(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.seconds[name] = self.seconds.get(name, 0.0) + time.perf_counter() - began

    def __str__(self) -> str:
        return ", ".join(f"{k} {v:.3f} s" for k, v in self.seconds.items())
