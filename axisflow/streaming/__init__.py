"""There is no streaming operator to match; staging expressions such as staging.to_float_table work on streaming tables as they are."""
