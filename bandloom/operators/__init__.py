"""Operators on images, blocks, bands and requests: functions from DataFrames to DataFrames."""
