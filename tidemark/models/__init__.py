"""Splits, classifiers and out-of-fold scoring on tables."""
