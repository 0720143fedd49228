"""Column functions used inside the table operators."""
