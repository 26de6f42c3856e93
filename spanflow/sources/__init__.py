"""Reading and writing: JDBC, catalog/Parquet tables, CSV, lineage stages."""

from spanflow.sources.jdbc import jdbc_options, read_jdbc
from spanflow.sources.tables import read_table, save_table, stage
from spanflow.sources.files import read_csv, read_parquet, write_csv, write_parquet

__all__ = ["jdbc_options", "read_jdbc", "read_table", "save_table", "stage",
           "read_csv", "read_parquet", "write_csv", "write_parquet"]
