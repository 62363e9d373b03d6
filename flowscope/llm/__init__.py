"""Operators for preparing training text: nothing else in flowscope imports them."""
