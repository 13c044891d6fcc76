"""Operators for preparing training corpora. Nothing else in tickloom imports this subpackage."""
