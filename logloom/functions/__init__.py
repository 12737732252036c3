"""Column functions: seeded draws, log fields, text and duration helpers."""
