"""jobs of the cycling library."""
