"""Column functions: sensors and sky."""
