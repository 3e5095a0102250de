"""From query text to DataFrames: tokens, syntax, names and types, compilation."""
