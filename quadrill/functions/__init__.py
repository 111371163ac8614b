"""Column functions: distances, boxes, labels, codes."""
