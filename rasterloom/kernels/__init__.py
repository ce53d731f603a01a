"""Numpy kernels for one dense tile each: arrays (band, row, column) in, labels (row, column) out."""
