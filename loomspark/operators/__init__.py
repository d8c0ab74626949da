"""Operators: alignment, mixing, rendering, stage processing, packing, metrics."""
