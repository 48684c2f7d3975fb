"""Quillion: lazy DataFrame operators for agent-memory data on Apache Spark."""
