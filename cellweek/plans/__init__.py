"""Whole jobs composed from the operators, each runnable with spark-submit."""
