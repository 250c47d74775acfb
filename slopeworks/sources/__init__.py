"""sources of the cycling library."""
