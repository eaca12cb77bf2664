"""Column expressions and small DataFrame building blocks shared by the operators."""
