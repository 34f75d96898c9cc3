"""Compositions of operators into the results a run publishes."""
