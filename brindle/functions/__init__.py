"""Scalar and aggregate functions with the request language's semantics."""
