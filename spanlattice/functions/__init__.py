"""Column functions: run-length arrays, their text form, boxes, indices, probabilities, names."""
