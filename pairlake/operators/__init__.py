"""operators of pairlake."""
