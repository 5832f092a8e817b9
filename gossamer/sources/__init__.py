"""Inputs: landed feeds, vocabulary, and the adapter over the test tables."""
