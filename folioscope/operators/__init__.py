"""operators of the layout engine."""
