"""Numeric building blocks: array columns, distributions and batch kernels."""
