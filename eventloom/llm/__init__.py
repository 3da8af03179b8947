"""Operators on text: tokens, packing, personal information. Nothing outside imports this package."""
