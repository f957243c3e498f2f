"""Column expressions and word lists used by the operators."""
