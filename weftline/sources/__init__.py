"""Sources and sinks of frames."""
