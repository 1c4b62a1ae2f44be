"""Feed a relation or function from a stream: each micro-batch is inserted, then rules run on what is new.

Seminaive runs make a micro-batch cost about as much as the facts that it adds, not as the database. Deduplication and
merges make a batch that is delivered twice change nothing, but for merges that add up; batch numbers that were applied
are remembered and skipped, so those are safe within a session as well. Nothing is retracted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rulespark.engine import Engine


def feed(engine: Engine, name: str, stream: DataFrame, schedule: str = "(saturate (run))", after: Callable[[Engine, int], None] | None = None, **options: str) -> StreamingQuery:
    """Start a query that inserts a stream's rows into a function and runs a schedule after each micro-batch.

    after(engine, batch) is called then, to write results. options: of the stream's writer, such as checkpointLocation.
    """
    done = engine.state.setdefault(("batches", name), set())

    def apply(batch: DataFrame, number: int) -> None:
        if number in done:
            return
        # The batch belongs to the stream's session: its rows are read there, and inserted in the engine's.
        rows = batch.persist()
        try:
            engine.insert_rows(name, rows)
        finally:
            rows.unpersist()
        engine.run(f"(run-schedule {schedule})")
        done.add(number)
        if after is not None:
            after(engine, number)

    writer = stream.writeStream.foreachBatch(apply).outputMode("append")
    for k, v in options.items():
        writer = writer.option(k, v)
    return writer.trigger(availableNow=True).start() if "availableNow" in options else writer.start()
