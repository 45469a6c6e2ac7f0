"""sparkmine plans."""
