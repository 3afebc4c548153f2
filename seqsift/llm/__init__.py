"""Operators for preparing training text: ten filters, scanners, deduplicators and mixers."""
