"""Exceptions of the lake."""


class LakeError(Exception):
    """Base of all errors of this package."""


class NotInitializedError(LakeError):
    """The catalog database holds no lake yet."""


class AlreadyInitializedError(LakeError):
    """The catalog database holds a lake already."""


class OutdatedVersionError(LakeError):
    """The catalog has an older layout; connect with migrate=True."""


class AlreadyExistsError(LakeError):
    """A schema, table or column of that name exists."""


class NotFoundError(LakeError):
    """No schema, table, column, tag or snapshot of that name."""


class InvalidCastError(LakeError):
    """The type change is not a promotion."""


class InvalidNullValueError(LakeError):
    """A column that allows no nulls would get one."""


class InvalidNullabilityChangeError(LakeError):
    """A column that holds nulls can't forbid them."""


class TransactionConflictError(LakeError):
    """Another commit since the transaction began touches the same things."""


class ReadonlyLakeError(LakeError):
    """The connection is read-only or pinned to a snapshot."""
