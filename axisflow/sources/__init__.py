"""Readers, generators, sinks and configurations."""
