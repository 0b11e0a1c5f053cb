"""streaming of tracewright."""
