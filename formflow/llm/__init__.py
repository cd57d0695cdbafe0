"""Operators for training text. Optional: the rest of the package never imports it."""
