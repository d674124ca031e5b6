"""Operators for training-data pipelines; nothing else in pairlake imports this subpackage."""
