"""Command families; each function evaluates a command over all keys of a table at once."""
