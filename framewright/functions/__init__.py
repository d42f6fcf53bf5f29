"""functions of framewright."""
