"""Stateful operators over ordered slices and over intervals, as streams and as batches with the same state functions."""
