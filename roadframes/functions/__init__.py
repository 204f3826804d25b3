"""Column functions and the Arrow-batched pixel kernels."""
