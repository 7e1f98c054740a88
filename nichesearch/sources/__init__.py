"""Readers of occurrence tables, predictor rasters and virtual species."""
