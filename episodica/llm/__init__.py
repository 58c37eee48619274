"""Operators for preparing large text corpora (training data) on Spark."""
