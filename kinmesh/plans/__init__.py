"""Whole plans: the linkage pipeline, and the queries over the test tables with their SQL."""
