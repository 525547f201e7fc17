"""Sources and sinks (A1-A9) plus the dimension tables."""
