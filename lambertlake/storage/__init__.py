"""Versioned store of spectra, methods and results with a hash-chained log."""
