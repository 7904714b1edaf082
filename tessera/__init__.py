"""Tessera: spatial niche analytics as Spark DataFrame operators."""
