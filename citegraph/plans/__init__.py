"""Complete runs over stored tables."""
