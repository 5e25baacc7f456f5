"""Analytics over sets of sequences, planned by Spark."""
