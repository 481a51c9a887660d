"""Registered queries: plans over the given tables, and DuckDB SQL that checks them."""
