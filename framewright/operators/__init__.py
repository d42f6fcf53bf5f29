"""operators of framewright."""
