"""Rule tables, word lists and constants that results depend on."""
