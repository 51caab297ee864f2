"""One run at a time: a lease in a shared folder, taken by whoever makes its next version first.

The lease is a store without tables, whose meta say who holds it and since when. Taking, renewing and giving
back each make a version, which only one writer can, so two drivers never hold it at once. A holder renews it
while it works; one that has not done so for `stale_seconds` is taken for dead, and the next one may take over.

Defined cases: a folder that does not exist yet is free; a lease that was lost to another holder is not given
back by the old one, whose block ends with LeaseLost.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark import InheritableThread
from pyspark.sql import SparkSession

from codequarry.sources.versions import State, Store

FREE = {"holder": None, "name": None, "since": None, "seen": None}


class Busy(RuntimeError):
    """Another run holds the lease."""


class LeaseLost(RuntimeError):
    """Another run has taken the lease over, as this one gave no sign of life."""


class Lease:
    def __init__(self, spark: SparkSession, folder: str, stale_seconds: float = 3600, clock: Callable[[], float] = time.time):
        self.store, self.stale_seconds, self.clock = Store(spark, folder), stale_seconds, clock
        self.holder = uuid.uuid4().hex
        self._renewing = threading.Lock()

    def state(self) -> dict:
        """Who holds the lease: holder, name, since, seen (seconds since 1970) and stale; holder is None if it is free."""
        meta = FREE | self.store.state().meta
        return meta | {"stale": meta["holder"] is not None and meta["seen"] < self.clock() - self.stale_seconds}

    def take(self, name: str) -> bool:
        """Hold the lease if it is free or stale, else raise Busy. Returns whether a stale run was replaced."""
        now, held = self.store.state(), self.state()
        if held["holder"] is not None and not held["stale"]:
            raise Busy(f"{held['name']} is running since {held['since']:.0f}")
        at = self.clock()
        if self.store.advance(now, {"holder": self.holder, "name": name, "since": at, "seen": at}) is None:
            raise Busy("another run was faster")
        self.store.vacuum(keep=2)
        return held["holder"] is not None

    def renew(self) -> None:
        self._put({"seen": self.clock()})

    def give_back(self) -> None:
        self._put(FREE)

    def _put(self, meta: dict) -> None:
        with self._renewing:
            now: State = self.store.state()
            if now.meta.get("holder") != self.holder or self.store.advance(now, meta) is None:
                raise LeaseLost(f"taken over by {now.meta.get('name')}")


@contextmanager
def single_flight(spark: SparkSession, folder: str, name: str, stale_seconds: float = 3600) -> Iterator[Lease]:
    """Hold the lease in folder while the block runs, or raise Busy; it is renewed three times in stale_seconds."""
    lease, done = Lease(spark, folder, stale_seconds), threading.Event()
    lease.take(name)

    def keep() -> None:
        while not done.wait(stale_seconds / 3):
            try:
                lease.renew()
            except LeaseLost:
                return  # the block learns of it at its end

    thread = InheritableThread(target=keep, daemon=True, session=spark)
    thread.start()
    try:
        yield lease
    finally:
        done.set()
        thread.join()
        lease.give_back()
