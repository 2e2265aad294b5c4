"""Exceptions of the engine."""


class TidemarkError(ValueError):
    """Base of all errors that a caller's arguments or data cause."""


class InvalidEntityPath(TidemarkError):
    pass


class UnknownKind(TidemarkError):
    pass


class SchemaMismatch(TidemarkError):
    pass


class InvertedBounds(TidemarkError):
    pass


class InvalidRadius(TidemarkError):
    pass


class VersionConflict(RuntimeError):
    """Another writer published the version first."""
