"""plans of netquarry."""
