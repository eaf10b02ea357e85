"""Statistics, series operators, calibration and multivariate methods over DataFrames."""
