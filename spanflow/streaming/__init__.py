"""The task-run rule on a Structured Streaming source."""

from spanflow.streaming.runs import run_stream, stream_runs_to_table

__all__ = ["run_stream", "stream_runs_to_table"]
