"""Repertoire analytics as composable Spark DataFrame operators."""
