"""Spark-first analytics over event ledgers, bars and quote streams."""
