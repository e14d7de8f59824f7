"""Column expressions: hashing, names, statistics, colours."""
