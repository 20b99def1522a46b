"""Operators over tables of spans and contracts."""
