"""Operators for the making of training text; nothing outside this folder imports them."""
