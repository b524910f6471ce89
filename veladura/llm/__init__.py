"""Operators for training-data preparation; nothing outside this subpackage imports it."""
