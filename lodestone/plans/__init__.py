"""The catalogue of queries over the test tables."""
