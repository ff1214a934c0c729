"""DataFrame operators: profiling, preparation, reduction and fidelity."""
