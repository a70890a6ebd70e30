"""plans of the siftwell engine."""
