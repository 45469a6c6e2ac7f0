"""sparkmine sources."""
