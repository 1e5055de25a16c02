"""Wiring of operators to the driver tables, one function per query."""
