"""Column expressions: versions, names, ranges, dates, hashes, text."""
