"""tickloom.operators."""
