"""versewise package."""
