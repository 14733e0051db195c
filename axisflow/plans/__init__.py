"""From configurations and query names to plans."""
