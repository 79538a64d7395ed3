"""Plans over streams. An extension: any plan of operators that Structured Streaming can run incrementally runs on a stream unchanged."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from ..plans.relation import PlanError, Relation
from ..session import Session


def bind_stream(session: Session, name: str, df: DataFrame, event_time: str | None = None, delay: str | None = None) -> Session:
    """Make a streaming DataFrame known under a name, with a watermark on its event time if one is given. A stream has no order."""
    if not df.isStreaming:
        raise PlanError(f"{name} is no stream")
    session.relations[name] = Relation(df.withWatermark(event_time, delay or "0 seconds") if event_time else df)
    return session


def writer(session: Session, plan: Any, mode: str = "append") -> DataStreamWriter:
    """The plan's stream, ready for a sink. Operators that need all rows in order raise when the plan is built or started."""
    df = session.dataframe(plan)
    if not df.isStreaming:
        raise PlanError("the plan reads no stream")
    return df.writeStream.outputMode(mode)


def start_memory(session: Session, plan: Any, name: str, mode: str = "append") -> StreamingQuery:
    """Run into an in-memory table, for tests and small results."""
    return writer(session, plan, mode).format("memory").queryName(name).start()
