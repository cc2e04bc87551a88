"""Operators that prepare training text and training rankings; nothing else in webloom imports this package."""
