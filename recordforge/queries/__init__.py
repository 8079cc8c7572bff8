"""Queries that show each operator on the test tables, with DuckDB SQL that gives the same rows."""
