"""Operators for preparing language-model training data; nothing outside this folder imports it."""
