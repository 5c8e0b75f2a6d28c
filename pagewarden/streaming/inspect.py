"""Page inspection over arriving page states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pagewarden.operators.privacy import sanitize_states
from pagewarden.sources.pages import payload_states


def inspect_stream(payloads: DataFrame) -> DataFrame:
    """Sanitized states of a stream of payloads: a stateless map, no shuffle."""
    return sanitize_states(payload_states(payloads))


def write_stream(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to files, exactly once; all that has arrived, then stop."""
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
