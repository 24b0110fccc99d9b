"""Column functions: coordinates, strands, sequences."""
