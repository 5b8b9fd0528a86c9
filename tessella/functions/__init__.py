"""Column functions: ids, keyed random numbers, vectors."""
