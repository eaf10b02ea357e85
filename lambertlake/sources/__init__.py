"""Readers and writers of spectra files."""
