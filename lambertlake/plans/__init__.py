"""Pipelines of operations on spectra and how they run."""
