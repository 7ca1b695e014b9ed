"""Operators for training data from language-model conversations. Nothing outside this subpackage imports it."""
