"""The scan over a stream of files."""
