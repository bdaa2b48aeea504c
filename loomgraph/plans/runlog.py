"""A campaign's log: JSON lines with everything that is logged or printed while its runs last.

``logging`` does the work. One file handler is put on the root logger for as
long as the log is open; a filter stamps each record with the approach that
is running. Print goes through a logger of its own, which also shows it.
"""

from __future__ import annotations

import contextlib
import io
import json
import logging
import os
import shutil
import sys
import tempfile
import time
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import SparkSession

from loomgraph.functions.names import is_remote
from loomgraph.sources.shared import get, put

EVENTS, PRINTED = logging.getLogger("loomgraph.campaign"), logging.getLogger("loomgraph.printed")


class _JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime(record.created))
        own = {"at": at, "approach": record.approach, "source": record.name, "level": record.levelname, "text": record.getMessage()}
        return json.dumps(own | getattr(record, "fields", {}), default=str)


class _Printed(io.TextIOBase):
    """Turns printed lines into log records."""

    def __init__(self) -> None:
        self.rest = ""

    def write(self, text: str) -> int:
        *lines, self.rest = (self.rest + text).split("\n")
        for line in lines:
            PRINTED.info("%s", line)
        return len(text)

    def close(self) -> None:
        if self.rest:
            PRINTED.info("%s", self.rest)
        self.rest = ""


class CampaignLog:
    """A log file to be used as a context; ``append`` goes on where there is one.

    A log in a store is written by the driver beside it and put there at the end.
    """

    def __init__(self, path: str | Path, append: bool = False, spark: SparkSession | None = None):
        self.path, self.spark, self.approach = path, spark, None
        before = get(spark, path) if append else None
        self.goes_on = before is not None
        self._local = Path(tempfile.mkdtemp(), "log") if is_remote(path) else Path(path)
        if is_remote(path) and self.goes_on:
            self._local.write_text(before)

    def __enter__(self) -> CampaignLog:
        os.makedirs(self._local.resolve().parent, exist_ok=True)
        self._file = logging.FileHandler(self._local, "a" if self.goes_on else "w")
        self._file.setFormatter(_JsonLines())
        self._file.addFilter(self._stamp)
        logging.getLogger().addHandler(self._file)
        self._levels = [(x, x.level) for x in (EVENTS, PRINTED)]
        for x, _ in self._levels:
            x.setLevel(logging.INFO)
        return self

    def __exit__(self, *_) -> None:
        self.event("end")
        logging.getLogger().removeHandler(self._file)
        self._file.close()
        for x, level in self._levels:
            x.setLevel(level)
        if is_remote(self.path):
            put(self.spark, self.path, self._local.read_text())
            shutil.rmtree(self._local.parent)

    def _stamp(self, record: logging.LogRecord) -> bool:
        record.approach = self.approach
        return True

    def event(self, what: str, **fields: object) -> None:
        """A line of the campaign itself: what happened, and with which settings or results."""
        EVENTS.info(what, extra={"fields": fields})

    @contextlib.contextmanager
    def running(self, approach: str) -> Iterator[None]:
        """While it lasts, records bear the approach, and what is printed is shown and logged."""
        self.approach, shown, printed = approach, logging.StreamHandler(sys.stdout), _Printed()
        PRINTED.addHandler(shown)
        try:
            with contextlib.redirect_stdout(printed):
                yield
        finally:
            printed.close()
            PRINTED.removeHandler(shown)
            self.approach = None
