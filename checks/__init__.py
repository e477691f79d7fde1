"""Registered queries with their SQL oracles, over tables that Spark derives from the given ones."""
