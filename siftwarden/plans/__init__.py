"""The query catalogue: each query with the SQL it is held against."""
