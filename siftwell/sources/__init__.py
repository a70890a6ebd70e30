"""sources of the siftwell engine."""
