"""Errors that end a run, with their exit codes."""

from __future__ import annotations

import errno


class EngineError(Exception):
    exit_code = 99


class ArgumentError(EngineError):
    exit_code = 1


class NoInputError(EngineError):
    exit_code = 2


class ConfigError(EngineError):
    exit_code = 3

    def __init__(self, wrong: list[str]):
        super().__init__("; ".join(wrong))
        self.wrong = wrong


class NothingReadableError(EngineError):
    exit_code = 4


class WriteError(EngineError):
    exit_code = 5


class StorageError(EngineError):
    exit_code = 6


class LibraryError(EngineError):
    exit_code = 7


def is_storage(e: BaseException | None) -> bool:
    """Whether disk or memory ran out, on the driver or on an executor."""
    while e is not None:
        if isinstance(e, (StorageError, MemoryError)) or (isinstance(e, OSError) and e.errno in (errno.ENOSPC, errno.EDQUOT)):
            return True
        if any(said in str(e) for said in ("No space left on device", "Disk quota exceeded", "OutOfMemoryError", "SparkOutOfMemory", "UNABLE_TO_ACQUIRE_MEMORY")):
            return True
        e = e.__cause__ or e.__context__
    return False


def is_engine(e: BaseException) -> bool:
    """Whether Spark itself failed while it ran."""
    return type(e).__module__.startswith(("pyspark.", "py4j."))
