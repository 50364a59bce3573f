"""sources of netquarry."""
