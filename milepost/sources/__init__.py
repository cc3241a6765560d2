"""Source tables: fixture views over the test tables, parquet / JDBC readers, master snapshots."""
