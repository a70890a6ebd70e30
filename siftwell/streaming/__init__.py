"""streaming of the siftwell engine."""
