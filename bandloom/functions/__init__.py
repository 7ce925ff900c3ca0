"""Dimension tables, array transforms and codecs."""
