"""Operators for preparing training texts. Nothing outside this package imports it."""
