"""tickloom.functions."""
