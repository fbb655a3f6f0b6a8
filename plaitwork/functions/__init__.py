"""Column functions, and the numpy kernels that tasks run."""
