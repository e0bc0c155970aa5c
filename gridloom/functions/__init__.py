"""Functions of the spatial engine."""
