"""Requests and their compilation to DataFrames."""
