"""Numeric kernels (numpy) and the adapters that run them in Spark."""
