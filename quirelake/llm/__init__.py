"""Operators for preparing training data: one module each, on DataFrames of documents or pages."""
