"""sparkmine functions."""
