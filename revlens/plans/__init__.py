"""Registered plans: one Spark plan per operator key, each with its
independent DuckDB SQL statement of the same result (the oracle)."""
