"""Registered queries over the driver tables, one module per family of operators."""
