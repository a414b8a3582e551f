"""Scalar functions on labels, templates and canonical JSON."""
