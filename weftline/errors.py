class InputValidationError(ValueError):
    """Operator inputs that do not fit together."""


class DuplicateTagError(ValueError):
    """An inserted row has the tags of a row that is there already."""


class SourceCollisionError(ValueError):
    """Another source is registered under the id."""
