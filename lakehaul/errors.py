from __future__ import annotations

import re

# Lines of a JVM stack trace.
_FRAME = re.compile(r"^\s*(at \S+\(|\.\.\. \d+ more)")


def message_of(error: Exception) -> str:
    """The text of an error, every line but those of a stack trace."""
    cause = getattr(error, "java_exception", None)
    told = str(error) if cause is None else cause.toString()
    lines = [line for line in told.splitlines() if not _FRAME.match(line)]
    return "\n".join(lines).strip() or type(error).__name__
