"""Occurrence records as a stream, parsed by the same expressions as files."""
