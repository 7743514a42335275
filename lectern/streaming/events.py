"""What happens in runs: a ring of the newest events of each, fed by Spark's own listener, and a stop between batches."""

from __future__ import annotations

import threading
from collections import OrderedDict, deque
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Events kept of each run, and runs kept.
MOST, RUNS = 400, 64


class Ring:
    """The newest `most` events of each of the newest `runs` runs; its size does not grow with what happens."""

    def __init__(self, most: int = MOST, runs: int = RUNS):
        self.most, self.runs, self._lock = most, runs, threading.Lock()
        self._events: OrderedDict[str, deque] = OrderedDict()
        self._counts: dict[str, int] = {}

    def add(self, run: str, event: dict) -> int:
        """Keep an event; its number in the run, from 1."""
        with self._lock:
            ring = self._events.setdefault(run, deque(maxlen=self.most))
            self._events.move_to_end(run)
            n = self._counts[run] = self._counts.get(run, 0) + 1
            ring.append({"seq": n, **event})
            while len(self._events) > self.runs:
                old, _ = self._events.popitem(last=False)
                del self._counts[old]
            return n

    def newest(self, run: str, after: int = 0) -> list[dict]:
        """The events of a run that are still there, those numbered over `after`, oldest first."""
        with self._lock:
            return [e for e in self._events.get(run, ()) if e["seq"] > after]

    def names(self) -> list[str]:
        with self._lock:
            return list(self._events)


class RunListener(StreamingQueryListener):
    """Feeds a ring with the starts, batches and ends of streaming queries; a run is a query's run id."""

    def __init__(self, ring: Ring):
        self.ring = ring

    def onQueryStarted(self, event) -> None:
        self.ring.add(str(event.runId), {"event": "started", "name": event.name, "at": event.timestamp})

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.ring.add(str(p.runId), {"event": "batch", "batch": p.batchId, "rows": p.numInputRows, "at": p.timestamp, "ms": p.batchDuration})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ring.add(str(event.runId), {"event": "failed" if event.exception else "ended", "error": (event.exception or "").split("\n")[0] or None})


class StopRequested(RuntimeError):
    """A stop was asked for; no batch was begun after that."""


def stoppable(batch: Callable[[DataFrame, int], None], asked: Callable[[], bool]) -> Callable[[DataFrame, int], None]:
    """A batch function that honours a stop before it begins a batch: one that has begun ends whole, the next runs when the stream starts again."""

    def run(rows: DataFrame, number: int) -> None:
        if asked():
            raise StopRequested(f"stopped before batch {number}")
        batch(rows, number)

    return run


def ended(query: StreamingQuery) -> bool:
    """Wait for a query; True if it was stopped by request, False if it came to its end. Any other failure is raised."""
    try:
        query.awaitTermination()
        return False
    except Exception as e:
        if "StopRequested" in str(e):
            return True
        raise
