"""operators of the cycling library."""
