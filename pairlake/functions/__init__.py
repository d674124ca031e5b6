"""functions of pairlake."""
