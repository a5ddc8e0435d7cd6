"""Column-expression helpers: counter-based RNG, bit-vector algebra, metrics."""
