"""Progress of a run: information on standard output, warnings and errors on standard error."""

from __future__ import annotations

import logging
import sys
from typing import TextIO

LOG = logging.getLogger("tidemark")


def setup(out: TextIO | None = None, err: TextIO | None = None) -> None:
    """Lines of time, level, step and message; a second call replaces the first."""
    form = logging.Formatter("%(asctime)s [%(levelname)s] [%(step)s] %(message)s", defaults={"step": "-"})
    low, high = logging.StreamHandler(out or sys.stdout), logging.StreamHandler(err or sys.stderr)
    low.addFilter(lambda r: r.levelno < logging.WARNING)
    high.setLevel(logging.WARNING)
    for h in (low, high):
        h.setFormatter(form)
    LOG.handlers = [low, high]
    LOG.setLevel(logging.INFO)
    LOG.propagate = False


def info(step: str, message: str) -> None:
    LOG.info(message, extra={"step": step})


def warning(step: str, message: str) -> None:
    LOG.warning(message, extra={"step": step})


def error(step: str, message: str) -> None:
    LOG.error(message, extra={"step": step})
