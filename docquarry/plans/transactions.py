"""Operations that begin again when another writer came first."""

from __future__ import annotations

import functools
import time

from docquarry.errors import ConcurrencyError


def changing(method):
    """An operation of a Store, or of what has one in _store, that reads and commits on one manifest and begins again if it lost the race."""

    @functools.wraps(method)
    def run(self, *args, **options):
        store = getattr(self, "_store", self)
        if store._pinned is not None:
            return method(self, *args, **options)
        end = time.monotonic() + store.lock_timeout
        while True:
            try:
                with store.transaction():
                    return method(self, *args, **options)
            except ConcurrencyError:
                if time.monotonic() > end:
                    raise
                time.sleep(min(0.2, store.lock_timeout))

    return run
