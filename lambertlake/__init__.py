"""Spark-native analytics for UV/Vis spectra of mixtures."""
