"""talus functions."""
