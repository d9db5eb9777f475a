"""Operators on DataFrames: windows, labels, features, evaluation, assessment, models."""
