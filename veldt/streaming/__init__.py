"""Queries over streams: a streaming DataFrame is a table like any other, and the result is a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veldt.session import Engine


def register_stream(engine: Engine, name: str, df: DataFrame, event_time: str | None = None, delay: str = "0 seconds") -> None:
    """Make a streaming DataFrame a table of the engine, with a watermark on its event time if there is one."""
    if not df.isStreaming:
        raise ValueError(f"{name} is no stream")
    engine.register(name, df.withWatermark(event_time, delay) if event_time else df)


def start(engine: Engine, query: str, sink: str = "memory", *, name: str | None = None, mode: str = "append", checkpoint: str | None = None, **options: str) -> StreamingQuery:
    """Start a query of the dialect over registered streams; mode complete or update for aggregates."""
    result = engine.sql(query)
    if result is None or not result.isStreaming:
        raise ValueError("the query reads no stream")
    writer = result.writeStream.format(sink).outputMode(mode).options(**options)
    if name:
        writer = writer.queryName(name)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start()
