"""Chemistry behind a backend interface."""
