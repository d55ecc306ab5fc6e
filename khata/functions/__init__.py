"""Column builders and fixed values shared by the operators."""
