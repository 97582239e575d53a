"""Skew-safe building blocks: ordered scans, exact quantiles, greedy selection, graph and range joins."""
