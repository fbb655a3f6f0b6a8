"""DataFrame operators: alignment, chaining, checks and work distribution."""
