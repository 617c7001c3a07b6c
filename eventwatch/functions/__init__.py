"""Column functions: field normalisation, text formatting, address enrichment."""
