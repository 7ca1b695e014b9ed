"""Background refinement of searches: tickets, a bounded pool, time budget, retention and cancellation."""

from __future__ import annotations

import threading
import time
import uuid
from collections import OrderedDict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from typing import Any

from threadloom.errors import EngineError

RUNNING, COMPLETED, FAILED = "RUNNING", "COMPLETED", "FAILED"


@dataclass(frozen=True)
class Ticket:
    """What a caller polls: the id, the state, the results so far and an error text."""

    search_id: str
    status: str
    results: list[Any] = field(default_factory=list)
    error: str | None = None


@dataclass
class _Job:
    owner: int
    ticket: Ticket
    created: float
    ended: float | None = None
    cancelled: threading.Event = field(default_factory=threading.Event)


class SearchJobs:
    """At most `most` jobs, oldest out first; finished ones are kept `retention` seconds; a job has `budget` seconds from its creation, waiting included.

    `workers` run at once and `queue` may wait; a job beyond that fails at once and keeps its first results. A state changes
    from RUNNING only. `spark` lets the budget cancel a job's Spark stages through its job group. A sweeper ends what is over its
    budget and drops what is over its retention every `sweep` seconds, whether anyone polls or not.
    """

    def __init__(self, spark=None, most: int = 200, retention: float = 300, budget: float = 15, workers: int = 2, queue: int = 16, clock: Callable[[], float] = time.monotonic, sweep: float = 1.0) -> None:
        self._spark, self._most, self._retention, self._budget, self._clock = spark, most, retention, budget, clock
        self._room = threading.BoundedSemaphore(workers + queue)
        self._pool = ThreadPoolExecutor(workers, thread_name_prefix="refine")
        self._jobs: OrderedDict[str, _Job] = OrderedDict()
        self._lock = threading.Lock()
        self._closed = threading.Event()
        threading.Thread(target=self._sweeper, args=(sweep,), name="sweep", daemon=True).start()

    def start(self, owner: int, first: list[Any], refine: Callable[[threading.Event], list[Any]] | None) -> Ticket:
        """A ticket with the first results; without `refine` it is complete at once."""
        key = str(uuid.uuid4())
        job = _Job(owner, Ticket(key, RUNNING if refine else COMPLETED, list(first)), self._clock(), None if refine else self._clock())
        with self._lock:
            self._sweep()
            self._jobs[key] = job
            while len(self._jobs) > self._most:
                _, old = self._jobs.popitem(last=False)
                old.cancelled.set()
        if refine:
            if self._room.acquire(blocking=False):
                self._pool.submit(self._run, key, job, refine)
            else:
                self._end(job, FAILED, error="too many searches")
        return job.ticket

    def _run(self, key: str, job: _Job, refine: Callable[[threading.Event], list[Any]]) -> None:
        try:
            if self._spark is not None:
                self._spark.sparkContext.setJobGroup(key, "search refinement", interruptOnCancel=True)
            if not job.cancelled.is_set():
                self._end(job, COMPLETED, refine(job.cancelled))
        except Exception as e:  # noqa: BLE001  a failed refinement keeps the first results
            self._end(job, FAILED, error=str(e)[:500])
        finally:
            self._room.release()

    def _sweeper(self, every: float) -> None:
        while not self._closed.wait(every):
            self.sweep()

    def sweep(self) -> None:
        """End the jobs that are over their budget, running or waiting, and drop the finished ones that are over their retention."""
        now = self._clock()
        with self._lock:
            self._sweep()
            late = [(k, j) for k, j in self._jobs.items() if j.ended is None and now - j.created > self._budget]
        for key, job in late:
            self._expire(key, job)

    def _expire(self, key: str, job: _Job) -> None:
        job.cancelled.set()
        self._end(job, FAILED, error="time budget exceeded")
        if self._spark is not None:
            self._spark.sparkContext.cancelJobGroup(key)

    def _end(self, job: _Job, status: str, results: list[Any] | None = None, error: str | None = None) -> bool:
        with self._lock:
            if job.ticket.status != RUNNING or (job.cancelled.is_set() and status == COMPLETED):
                return False
            job.ticket = replace(job.ticket, status=status, error=error, results=job.ticket.results if results is None else list(results))
            job.ended = self._clock()
            return True

    def _sweep(self) -> None:
        now = self._clock()
        for key in [k for k, j in self._jobs.items() if j.ended is not None and now - j.ended > self._retention]:
            del self._jobs[key]

    def poll(self, owner: int, search_id: str) -> Ticket:
        """The ticket of the owner's search; unknown, expired and other owners' ids are an error with status 404."""
        with self._lock:
            self._sweep()
            job = self._jobs.get(search_id)
        if job is None or job.owner != owner:
            raise EngineError("no such search", "SEARCH_NOT_FOUND", 404)
        return job.ticket

    def cancel(self, owner: int, search_id: str) -> Ticket:
        self.poll(owner, search_id)
        job = self._jobs[search_id]
        job.cancelled.set()
        self._end(job, FAILED, error="cancelled")
        if self._spark is not None:
            self._spark.sparkContext.cancelJobGroup(search_id)
        return job.ticket

    def close(self) -> None:
        self._closed.set()
        self._pool.shutdown(wait=False, cancel_futures=True)
