"""talus streaming."""
