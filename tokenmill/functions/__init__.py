"""Column expressions: seeded hashing, text rules, token arrays."""
