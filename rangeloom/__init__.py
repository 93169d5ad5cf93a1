"""Laser-scan analytics expressed as Spark DataFrame transformations."""
