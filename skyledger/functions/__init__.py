"""Column expressions: pure, row-level, usable on batch and streaming frames alike."""
