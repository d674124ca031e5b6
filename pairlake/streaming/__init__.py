"""streaming of pairlake."""
