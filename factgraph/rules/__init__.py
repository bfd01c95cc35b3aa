"""Rule tables as data."""
