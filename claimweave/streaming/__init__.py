"""Claims that arrive as a stream."""
