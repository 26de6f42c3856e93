"""spanflow: keystroke event-log analytics on Spark DataFrames.

The work is organised as:

* ``spanflow.functions`` - Column-valued building blocks (classification, time,
  regex spans, penalty arithmetic).  Everything here is a built-in Spark
  expression; no Python worker is involved.
* ``spanflow.operators`` - DataFrame -> DataFrame operators (sessionization,
  run strings, islands, penalties, commands, features, sampling, models).
* ``spanflow.sources`` - reading and writing: JDBC, Parquet tables, CSV and
  lineage-cutting stages.
* ``spanflow.plans`` - the end-to-end jobs and the registered query catalog.
* ``spanflow.streaming`` - the task-run rule on a Structured Streaming source.
"""

from spanflow.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
__version__ = "0.1.0"
