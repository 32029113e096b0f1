"""lodestream: record-store, event-log and text-corpus analytics as plain PySpark jobs."""
