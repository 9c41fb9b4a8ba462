"""talus operators."""
