"""Training-data operators; nothing else in loomgraph imports this package."""
