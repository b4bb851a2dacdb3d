"""Columns and distribution functions."""
