"""Another attempt at what may work the next time."""

from __future__ import annotations

import time
import urllib.error
from collections.abc import Callable

ATTEMPTS, WAIT = 3, 0.5


def passing(error: Exception) -> bool:
    """Whether an error may pass: time-outs, refused connections, answers of an overloaded or broken server, and failures of a
    connector; not a request that is wrong or a table that is not there."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code >= 500 or error.code == 429
    if type(error).__name__ in ("Py4JJavaError", "UnknownException"):
        return True
    return isinstance(error, OSError)


def retried(call: Callable, attempts: int = ATTEMPTS, wait: float = WAIT):
    """What call gives, after at most so many attempts; waits twice as long before each next one."""
    for k in range(max(1, attempts)):
        try:
            return call()
        except Exception as e:
            if k + 1 >= attempts or not passing(e):
                raise
            time.sleep(wait * 2**k)
