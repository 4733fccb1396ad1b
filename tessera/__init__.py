"""Tessera: a schema-first query engine whose execution engine is Spark."""
