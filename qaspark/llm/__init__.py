"""Operators that turn raw corpora into training data; nothing else in the library imports this package."""
