"""Tideline: sensor, record and text analytics as plain Spark DataFrame jobs."""
