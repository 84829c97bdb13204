"""The collection operators."""
