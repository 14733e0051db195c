"""Helpers without tables of their own."""
