"""DataFrame to DataFrame operators, keyed by match."""
