"""sources of tracewright."""
