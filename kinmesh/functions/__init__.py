"""Column functions and pure-Python kernels."""
