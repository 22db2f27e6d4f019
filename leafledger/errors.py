"""Errors raised on the driver, before a plan is made."""


class LedgerError(ValueError):
    """Base class."""


class InvalidName(LedgerError):
    """A collection name breaks the grammar or collides with another one's short code."""


class InvalidSelector(LedgerError):
    """A selector or id does not fit the collection."""


class NotFound(LedgerError):
    """A document that must exist does not."""


class TransactionError(LedgerError):
    """No such transaction, or none is active."""


class ValidationError(LedgerError):
    """A document breaks its schema."""


class CryptoError(LedgerError):
    """Bad key, or a ciphertext that does not authenticate."""
