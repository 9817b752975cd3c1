"""Column functions: numbers, hashing, sets and the rule language."""
