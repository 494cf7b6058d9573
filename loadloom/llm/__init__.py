"""Operators for preparing training corpora, each with its query in ``queries``."""
