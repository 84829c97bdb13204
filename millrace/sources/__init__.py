"""Where collections come from."""
