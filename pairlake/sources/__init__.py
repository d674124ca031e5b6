"""sources of pairlake."""
