"""What this engine raises."""


class RillwoodError(RuntimeError):
    """Any error of this engine."""


class StreamError(RillwoodError):
    """A stream can't do what it was asked."""
