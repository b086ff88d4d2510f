"""Analytics engine."""
