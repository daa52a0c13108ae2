"""Column helpers and the fixed values shared by the operators."""
