"""Spark-native record linkage: normalise, block, compare, classify, decide, evaluate."""
