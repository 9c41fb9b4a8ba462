"""talus sources."""
