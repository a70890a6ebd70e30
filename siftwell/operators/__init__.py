"""operators of the siftwell engine."""
