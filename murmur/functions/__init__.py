"""Column-expression functions (text rules, word lists)."""
