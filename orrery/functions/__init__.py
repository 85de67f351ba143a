"""Column expressions: parameter boxes, axes, scales, targets, weights, text normalisers."""
