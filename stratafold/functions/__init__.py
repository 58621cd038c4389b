"""Scalar functions over Columns and their numpy twins."""
