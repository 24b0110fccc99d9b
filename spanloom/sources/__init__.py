"""Readers and writers of interval formats, and the interval view of the sample tables."""
