"""streaming of framewright."""
