"""Operators on tables, tensors and models."""
