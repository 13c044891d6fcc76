"""tickloom.sources."""
