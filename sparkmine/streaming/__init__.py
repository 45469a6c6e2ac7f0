"""sparkmine streaming."""
