"""operators of netquarry."""
