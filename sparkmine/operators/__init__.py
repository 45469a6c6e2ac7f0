"""sparkmine operators."""
