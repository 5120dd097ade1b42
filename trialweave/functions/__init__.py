"""Column expressions and distributed running sums and quantiles."""
