"""sources of framewright."""
