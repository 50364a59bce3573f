"""functions of netquarry."""
