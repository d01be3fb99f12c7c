"""Batch sources and the synthetic generator."""
