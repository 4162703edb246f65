"""Logging: one format, a level by name, and a context of key=value pairs before each message."""

from __future__ import annotations

import logging
import sys

LINE = "%(asctime)s %(levelname)s %(name)s: %(message)s"


class Context(logging.LoggerAdapter):
    """Puts its pairs before each message, as [a=1 b=2]."""

    def process(self, msg, kwargs):
        pairs = " ".join(f"{k}={v}" for k, v in self.extra.items())
        return (f"[{pairs}] {msg}" if pairs else msg), kwargs

    def bound(self, **more) -> Context:
        return Context(self.logger, {**self.extra, **more})


def setup(level: str | int = "INFO", file: str | None = None) -> logging.Logger:
    """Sends the package's messages to the error stream and, if named, a file. A second call replaces the first."""
    top = logging.getLogger("pointlake")
    for old in top.handlers[:]:
        top.removeHandler(old)
        old.close()
    for handler in [logging.StreamHandler(sys.stderr), *([logging.FileHandler(file, encoding="utf-8")] if file else [])]:
        handler.setFormatter(logging.Formatter(LINE))
        top.addHandler(handler)
    top.setLevel(level)
    return top


def get(name: str, **pairs) -> Context:
    return Context(logging.getLogger(f"pointlake.{name}"), pairs)
