"""Voxmere: volumetric image analytics as ordinary Spark DataFrame transformations."""
