"""Log lines as JSON."""

from __future__ import annotations

import json
import logging
import sys
from datetime import UTC, datetime

LOGGER = logging.getLogger("citelume")


class JsonLines(logging.Formatter):
    """A record as one line: time, level, logger, message, what was passed as fields, and an exception's text."""

    def format(self, record: logging.LogRecord) -> str:
        line = {"time": datetime.fromtimestamp(record.created, UTC).isoformat(timespec="milliseconds"), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        line |= getattr(record, "fields", {})
        if record.exc_info:
            line["exception"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def configure(level: int | str = logging.INFO, stream=None) -> logging.Logger:
    """Sends the package's records to a stream (standard output) as JSON lines, once."""
    for old in [h for h in LOGGER.handlers if isinstance(h.formatter, JsonLines)]:
        LOGGER.removeHandler(old)
    handler = logging.StreamHandler(stream or sys.stdout)
    handler.setFormatter(JsonLines())
    LOGGER.addHandler(handler)
    LOGGER.setLevel(level)
    LOGGER.propagate = False
    return LOGGER


def event(message: str, **fields) -> None:
    LOGGER.info(message, extra={"fields": fields})
