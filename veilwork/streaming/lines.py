"""Lines from a stream. The decision needs its own row only, so a stream needs no state; header flags come with the row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from veilwork.operators.redaction import redact_lines


def redact_stream(lines: DataFrame, text: str = "text") -> DataFrame:
    """lines, a streaming DataFrame, with what `redact_lines` adds."""
    if not lines.isStreaming:
        raise ValueError("lines is not a stream")
    return redact_lines(lines, text)


def start(redacted: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes a redacted stream as Parquet, exactly once for each row."""
    writer = redacted.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
