"""tickloom.streaming."""
