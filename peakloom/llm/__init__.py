"""Operators for preparing training text at scale; nothing else in peakloom imports this package."""
