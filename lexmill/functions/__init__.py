"""Column expressions; none needs Python workers."""
