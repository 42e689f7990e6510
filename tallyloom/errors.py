"""What can go wrong, by whose fault."""


class StoreError(Exception):
    """Any error of the library."""


class BadRequest(StoreError):
    """The arguments or the events are wrong; nothing was read or written."""


class StoreClosed(StoreError):
    """The store was closed."""


class Corrupt(StoreError):
    """Stored data is not what was written."""
