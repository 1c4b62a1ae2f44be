"""Primitive functions of the rule language, as expressions on columns."""
