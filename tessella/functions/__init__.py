"""Column expressions: vectors, texts, hashes, dates."""
