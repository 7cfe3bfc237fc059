"""Sequencing-read data and plain record tables as Spark DataFrames: parsing, typing, deltas, models, archives."""
