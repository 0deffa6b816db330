"""Column -> Column functions (text normalisation, message arrays, JSON shapes)."""
