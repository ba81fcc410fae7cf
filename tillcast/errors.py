"""Errors a caller can act on."""


class ModelNotTrained(RuntimeError):
    """No completed model version lies under the given path."""


class UntrainableData(ValueError):
    """The history cannot support a fit, for example one label class only."""
