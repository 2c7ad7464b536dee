"""Locks by scope: in one process, and between processes of one machine or shared file system."""

from __future__ import annotations

import fcntl
import hashlib
import os
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from tidemark.functions.identity import require_coordinate


class LockTimeout(TimeoutError):
    """The lock was not free within the time given."""


class ProcessLocks:
    """A mutex for each scope; a scope's entry goes with its last user."""

    def __init__(self, timeout: float | None = None):
        self.timeout = timeout
        self._guard = threading.Lock()
        self._held: dict[str, list] = {}

    @contextmanager
    def lock(self, scope: str) -> Iterator[None]:
        require_coordinate(scope, "the lock scope")
        with self._guard:
            entry = self._held.setdefault(scope, [threading.Lock(), 0])
            entry[1] += 1
        try:
            if not entry[0].acquire(timeout=-1 if self.timeout is None else self.timeout):
                raise LockTimeout("the dataset is locked by another user of this process")
            try:
                yield
            finally:
                entry[0].release()
        finally:
            with self._guard:
                entry[1] -= 1
                if not entry[1]:
                    del self._held[scope]


class FileLocks:
    """Advisory file locks in a folder; the system frees them when their process ends. Polled, with one deadline."""

    def __init__(self, folder: str, timeout: float | None = None, poll: float = 0.05):
        self.folder, self.timeout, self.poll = folder, timeout, poll
        os.makedirs(folder, exist_ok=True)

    @contextmanager
    def lock(self, scope: str) -> Iterator[None]:
        require_coordinate(scope, "the lock scope")
        name = hashlib.blake2b(scope.encode(), digest_size=16).hexdigest()
        deadline = None if self.timeout is None else time.monotonic() + self.timeout
        with open(os.path.join(self.folder, name), "a") as file:
            while True:
                try:
                    fcntl.flock(file, fcntl.LOCK_EX | fcntl.LOCK_NB)
                    break
                except BlockingIOError:
                    if deadline is not None and time.monotonic() >= deadline:
                        raise LockTimeout("the dataset is locked by another process") from None
                    time.sleep(self.poll)
            yield


#: What engines of one process share, so that two of them exclude each other.
SHARED = ProcessLocks()
