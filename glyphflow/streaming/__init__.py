"""Sessions as state, and files that arrive as a stream."""
