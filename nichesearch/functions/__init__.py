"""Column functions: hash draws, parsing of field data, map geometry."""
