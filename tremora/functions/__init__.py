"""Column expressions of the domain: features, signals, power."""
