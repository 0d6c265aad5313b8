"""Part of siftwell."""
