"""A workflow of steps that stops at the first one that fails."""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

log = logging.getLogger(__name__)


def run(steps: Sequence[tuple[str, Callable[[], int]]], skip: Sequence[str] = ()) -> tuple[int, list[str]]:
    """Runs (name, step) in order; a step that returns another code than 0 or raises ends the run, so nothing reads stale output.

    Returns the code (1 on failure) and the names of the steps that succeeded.
    """
    done: list[str] = []
    for name, step in steps:
        if name in skip:
            log.info("%s skipped", name)
            continue
        try:
            code = step()
        except Exception:
            log.exception("%s failed", name)
            return 1, done
        if code:
            log.error("%s failed with code %s", name, code)
            return 1, done
        done.append(name)
        log.info("%s done", name)
    return 0, done
