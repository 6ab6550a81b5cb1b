"""Operators for preparing training text: joins, filters, models, mixing and encodings."""
