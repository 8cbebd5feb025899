"""The jobs of the engine: configuration, registry of fitted models, stages and the command line."""
