"""Holds nothing yet: the engine that sets the scope has no streaming, so none is claimed here.

A Collection over ``spark.readStream`` can use the narrow operators as they are.
"""
