"""Reading, writing and describing tables."""
