"""Sources: files, streams, and the seeded generator."""
