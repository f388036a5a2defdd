"""Frame sequences as streams."""
