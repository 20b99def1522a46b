"""Trace conformance on Spark: spans and contracts in, verdicts out, for all traces at once."""
