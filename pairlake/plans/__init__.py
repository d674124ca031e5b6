"""plans of pairlake."""
