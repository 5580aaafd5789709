"""What keeps a driver process in order: one run at a time, and its log file."""

from __future__ import annotations

import fcntl
import logging
import os
from logging.handlers import TimedRotatingFileHandler
from pathlib import Path


class ProcessLock:
    """One process at a time holds a file; the system lets go of it when the process ends, however it ends."""

    def __init__(self, path: str):
        self.path = path
        self._file = None

    def acquire(self) -> bool:
        Path(self.path).parent.mkdir(parents=True, exist_ok=True)
        file = open(self.path, "a+", encoding="utf-8")
        try:
            fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            file.close()
            return False
        file.truncate(0)
        file.write(str(os.getpid()))
        file.flush()
        self._file = file
        return True

    def release(self) -> None:
        if self._file is not None:
            self._file.close()
            self._file = None

    def __enter__(self) -> "ProcessLock":
        if not self.acquire():
            raise RuntimeError(f"another process holds {self.path}")
        return self

    def __exit__(self, *_) -> None:
        self.release()


def logger(name: str, folder: str, days: int = 30, level: int = logging.INFO) -> logging.Logger:
    """A logger to a file that is replaced at midnight and kept for `days`; asked for again it is the same."""
    found = logging.getLogger(name)
    if not found.handlers:
        Path(folder).mkdir(parents=True, exist_ok=True)
        handler = TimedRotatingFileHandler(Path(folder) / f"{name}.log", when="midnight", backupCount=days, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        found.addHandler(handler)
        found.setLevel(level)
    return found
