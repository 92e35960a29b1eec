"""Column expressions: dates, grid arithmetic, holidays, output rounding."""
