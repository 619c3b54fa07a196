"""Column functions: Column in, Column out, no plan nodes of their own."""
