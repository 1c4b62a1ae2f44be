"""Facts from files, and results to files."""
