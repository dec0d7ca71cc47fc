"""A stream that is paused and taken up again (SQ4, WN8).

A run reads its source at a limited rate. Pausing stops the query after the batch at hand, going on starts it again from its checkpoint, so every
batch is written once whatever the pauses. What happened is an event log (run, t, kind): start, pause, resume and end, from which
``plans.runs.active_seconds`` takes the time that the run really worked. Batches and their rows come from a listener.

Cases: a pause before the first batch, or asked for twice, is one pause; a run that has ended has nothing left to do; a run that broke off goes on
like a paused one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

EVENTS = "run string, t double, kind string"


class _Batches(StreamingQueryListener):
    """Rows of each batch of the queries that write to one folder."""

    def __init__(self) -> None:
        self.rows: dict[int, int] = {}
        self.ids: set[str] = set()

    def onQueryStarted(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event: object) -> None:  # noqa: N802
        if str(event.progress.id) in self.ids and event.progress.numInputRows:
            self.rows[event.progress.batchId] = event.progress.numInputRows

    def onQueryIdle(self, event: object) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event: object) -> None:  # noqa: N802
        pass


class PausableRun:
    """Runs ``step(batch, number)`` on the batches of a stream, until it is paused or nothing is left."""

    def __init__(self, name: str, stream: Callable[[], DataFrame], step: Callable[[DataFrame, int], None], checkpoint: str, clock: Callable[[], float] = time.time) -> None:
        self.name, self.stream, self.step, self.checkpoint, self.clock = name, stream, step, checkpoint, clock
        self.log: list[tuple[str, float, str]] = []
        self.batches, self.ended = _Batches(), False

    def _note(self, kind: str) -> None:
        self.log.append((self.name, float(self.clock()), kind))

    def go(self, batches: int | None = None) -> bool:
        """Starts or goes on; pauses after so many batches. True once nothing is left."""
        if self.ended:
            return True
        self._note("resume" if self.log else "start")
        done = []

        def each(batch: DataFrame, number: int) -> None:
            if batches is not None and len(done) >= batches:
                # the batch isn't committed, and comes again when the run goes on
                raise Paused
            self.step(batch, number)
            done.append(number)

        df = self.stream()
        spark = df.sparkSession
        spark.streams.addListener(self.batches)
        query: StreamingQuery | None = None
        try:
            query = df.writeStream.foreachBatch(each).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
            self.batches.ids.add(str(query.id))
            try:
                query.awaitTermination()
                self.ended = True
            except Exception:
                if batches is None or len(done) < batches:
                    raise
        finally:
            if query is not None:
                query.stop()
            spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
            spark.streams.removeListener(self.batches)
            self._note("end" if self.ended else "pause")
        return self.ended

    def events(self, spark: SparkSession) -> DataFrame:
        """The run's log, as ``active_seconds`` takes it."""
        return spark.createDataFrame(self.log, EVENTS)


class Paused(Exception):  # noqa: N818
    """The run stops before the batch at hand."""
