"""functions of the cycling library."""
