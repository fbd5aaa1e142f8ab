"""Retries with backoff, and the errors that decide about them."""

from __future__ import annotations

import logging
import random
import time
from collections.abc import Callable
from typing import TypeVar

log = logging.getLogger(__name__)
T = TypeVar("T")
nap = time.sleep


class BlockNotFound(Exception):
    """The node has no such block yet."""


class RateLimited(Exception):
    """The node asks to wait."""


class Reorganised(Exception):
    """A block's parent is not the block that was processed before it."""


class Stopped(Exception):
    """The work was shut down."""


def retry(call: Callable[[], T], first: float = 1.0, factor: float = 2.0, most: float = 30.0, passes: tuple[type[BaseException], ...] = (Reorganised, Stopped), attempts: int | None = None, sleep: Callable[[float], None] | None = None) -> T:
    """Call until it works; the delay doubles up to ``most`` seconds, plus up to as much at random."""
    delay, n = first, 0
    while True:
        try:
            return call()
        except passes:
            raise
        except Exception as e:
            n += 1
            if attempts is not None and n >= attempts:
                raise
            wait = delay + random.uniform(0, delay)
            log.warning("attempt %d failed: %s; again in %.1f s", n, e, wait)
            (sleep or nap)(wait)
            delay = min(delay * factor, most)
