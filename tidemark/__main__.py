"""python -m tidemark LOGS [--out FOLDER] [--settings FILE]"""

from __future__ import annotations

import argparse
import os
import sys

from . import config, errors, progress


def spark_settings(settings: config.Config) -> dict[str, str]:
    """The memory and the folder that the settings grant, for a driver started here."""
    amount = settings.get("duckdb.max_memory").upper().removesuffix("B")
    number, unit = float(amount[:-1]), amount[-1].lower()
    exact = f"{int(number)}{unit}" if number.is_integer() else f"{int(number * 1024)}{ {'t': 'g', 'g': 'm', 'm': 'k', 'k': ''}[unit] }"
    return {"spark.driver.memory": exact, "spark.local.dir": os.path.abspath(settings.get("duckdb.temp_directory"))}


def main(argv: list[str] | None = None) -> int:
    """Exit codes: 0 done, 1 arguments, 2 no files, 3 settings, 4 nothing readable, 5 writing, 6 storage, 7 library, 99 other."""
    progress.setup()
    try:
        try:
            parser = argparse.ArgumentParser("tidemark", exit_on_error=False)
            parser.add_argument("logs")
            parser.add_argument("--out", default="report")
            parser.add_argument("--settings", default="settings.properties")
            args = parser.parse_args(argv)
        except (argparse.ArgumentError, SystemExit) as e:
            raise errors.ArgumentError(str(e)) from e
        if "://" not in args.logs and not os.path.isdir(args.logs):
            raise errors.ArgumentError(f"{args.logs} is no folder")
        settings = config.load(args.settings)
        for w in settings.warnings:
            progress.warning("S2", w)
        try:
            from .plans.run import run
            from .session import session
        except ImportError as e:
            raise errors.LibraryError(str(e)) from e
        spark = session("tidemark", **spark_settings(settings))
        _, written = run(spark, args.logs, settings, args.out)
        for path in written:
            progress.info("S9", f"wrote {path}")
        return 0
    except errors.EngineError as e:
        progress.error("-", str(e))
        return e.exit_code
    except Exception as e:  # noqa: BLE001  anything else ends the run with one code
        if errors.is_storage(e) or errors.is_engine(e):
            progress.error("-", f"storage or engine: {(str(e).splitlines() or [type(e).__name__])[0]}")
            return errors.StorageError.exit_code
        progress.LOG.exception("unexpected", extra={"step": "-"})
        return 99


if __name__ == "__main__":
    sys.exit(main())
