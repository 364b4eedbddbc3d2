"""DataFrame-in, DataFrame-out analyses."""
