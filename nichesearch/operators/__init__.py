"""Operators over occurrences (record_id, row, col, label, obs_date) and the grid (row, col, predictors)."""
