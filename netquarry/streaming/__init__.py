"""streaming of netquarry."""
