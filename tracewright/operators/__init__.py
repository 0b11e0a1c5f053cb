"""operators of tracewright."""
