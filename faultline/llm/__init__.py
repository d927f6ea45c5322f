"""Operators for training-data work on texts and labels; nothing outside this subpackage imports it."""
