"""What the engine raises for its callers."""


class EngineError(Exception):
    """A request that cannot be met, with a message for the user."""


class NoIndex(EngineError, FileNotFoundError):
    """There is no index yet."""


class NoSearchTerms(EngineError, ValueError):
    """The query holds filters only."""


class NotIndexed(EngineError, LookupError):
    """The file named is not in the index."""
