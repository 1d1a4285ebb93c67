"""Operators for preparing training corpora; nothing else in chronoloom imports this package."""
