"""The query catalogue: one query for each operator, with its SQL."""
