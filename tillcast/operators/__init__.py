"""DataFrame-to-DataFrame steps between the star schema and the models."""
