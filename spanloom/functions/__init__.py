"""Column expressions: range arithmetic, aggregates, sequence and text helpers."""
