"""Refusals that a user can act on; none of them quotes a data value."""


class MillError(Exception):
    """Base of all refusals."""


class SourceError(MillError):
    """The file cannot be read as declared."""


class SchemaError(MillError):
    """The schema document is not valid."""


class PolicyError(MillError):
    """Unknown policy or an override out of range."""


class MetricError(MillError):
    """A metric is not allowed, does not bind, fails or returns too much."""


class MappingError(MillError):
    """A column mapping cannot be proposed, verified or approved."""


class AuditError(MillError):
    """The audit log is damaged or refuses an entry."""


class SignoffError(MillError):
    """A sign-off is not admissible."""
