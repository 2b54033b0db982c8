"""Complete jobs composed of the operators."""
