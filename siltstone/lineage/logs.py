"""Logging: level and format from the environment, and times of calls."""

from __future__ import annotations

import functools
import logging
import os
import time
from collections.abc import Callable

FORMAT = "%(asctime)s %(levelname)s %(name)s: %(message)s"


def setup(level: str | None = None, text: str | None = None) -> logging.Logger:
    """The package's logger, set up once; SILTSTONE_LOG_LEVEL and SILTSTONE_LOG_FORMAT are the defaults."""
    log = logging.getLogger("siltstone")
    if not log.handlers:
        handler = logging.StreamHandler()
        handler.setFormatter(logging.Formatter(text or os.environ.get("SILTSTONE_LOG_FORMAT", FORMAT)))
        log.addHandler(handler)
        log.propagate = False
    log.setLevel((level or os.environ.get("SILTSTONE_LOG_LEVEL", "WARNING")).upper())
    return log


def timed(call: Callable) -> Callable:
    """Logs how long each call took."""

    @functools.wraps(call)
    def run(*args, **kwargs):
        began = time.perf_counter()
        try:
            return call(*args, **kwargs)
        finally:
            logging.getLogger(f"siltstone.{call.__module__.rpartition('.')[2]}").debug("%s took %.3f s", call.__qualname__, time.perf_counter() - began)

    return run
