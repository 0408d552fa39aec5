"""Named queries on the driver's tables, each with the DuckDB SQL that gives the same rows."""
