"""Whole evaluations, and the named queries over the test tables."""
