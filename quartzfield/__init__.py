"""Diffuse-scattering analytics as Spark DataFrame transformations."""
