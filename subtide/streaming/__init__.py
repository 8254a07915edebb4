"""Caption files that arrive in a directory, as Structured Streaming queries."""
