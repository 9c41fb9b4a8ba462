"""talus plans."""
