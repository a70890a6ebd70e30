"""functions of the siftwell engine."""
