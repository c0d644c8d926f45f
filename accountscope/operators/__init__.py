"""Operators: pure ``DataFrame -> DataFrame`` functions keyed by account id."""
