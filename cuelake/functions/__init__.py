"""Column functions of the library."""
