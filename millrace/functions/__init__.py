"""Reducers as Catalyst expressions."""
