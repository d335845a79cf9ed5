"""Operators for training data built from the domain tables; nothing outside this subpackage imports it."""
