"""plans of framewright."""
