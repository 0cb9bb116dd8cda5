"""Spark-native probabilistic data cleaning: detect, propose, score and repair the cells of a table."""
