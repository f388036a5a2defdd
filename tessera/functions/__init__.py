"""Column functions and settings."""
