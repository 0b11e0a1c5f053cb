"""functions of tracewright."""
