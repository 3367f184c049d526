"""Provenance-manifest analytics as Spark plans."""
