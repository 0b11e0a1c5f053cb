"""plans of tracewright."""
