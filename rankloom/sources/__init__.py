"""Readers and writers: datasets, indexes, reports."""
