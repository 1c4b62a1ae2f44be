"""Distributed operators that Spark lacks."""
