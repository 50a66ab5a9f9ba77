"""Numpy kernels without Spark."""
