"""Error taxonomy. The message prefixes."""

from __future__ import annotations

import re


class ExtractError(Exception):
    """Base of all errors of this library; also the one for unforeseen failures."""

    prefix = "Unknown error"

    def __init__(self, detail: str | None = None) -> None:
        self.detail = detail
        super().__init__(self.prefix if detail is None else f"{self.prefix}: {detail}")


class NetworkError(ExtractError):
    prefix = "Network request failed"


class JsonParsingError(ExtractError):
    prefix = "Failed to parse JSON response"


class SourceIOError(ExtractError):
    prefix = "I/O error"


class ArchiveError(ExtractError):
    prefix = "ZIP archive error"


class InvalidArxivId(ExtractError):
    prefix = "Invalid arXiv ID"


class NoPaperIdsProvided(ExtractError):
    prefix = "No paper IDs provided"


class BibtexParsingError(ExtractError):
    prefix = "Failed to parse BibTeX entry"


class ApiError(ExtractError):
    prefix = "API error"


#: Exceptions of other libraries, by name, and the errors they become.
_FOREIGN = {
    "JSONDecodeError": JsonParsingError, "BadZipFile": ArchiveError, "ReadError": ArchiveError, "CompressionError": ArchiveError,
    "EOFError": ArchiveError, "BadGzipFile": ArchiveError, "UnicodeDecodeError": SourceIOError, "FileNotFoundError": SourceIOError,
    "PermissionError": SourceIOError, "OSError": SourceIOError, "URLError": NetworkError, "HTTPError": ApiError, "TimeoutError": NetworkError,
}
_LAST_LINE = re.compile(r"^(?:[\w.]+\.)?(\w+)(?:: (.*))?$", re.M)


def _of_task(text: str) -> ExtractError | None:
    """The error that a task's traceback ends with, as Spark passes it on in its own error's text."""
    own = {c.__name__: c for c in ExtractError.__subclasses__()}
    for name, detail in reversed(_LAST_LINE.findall(text)):
        if name in own:
            kind, prefix = own[name], own[name].prefix
            rest = detail.removeprefix(prefix).removeprefix(": ")
            return kind(rest) if rest else kind()
        if name in _FOREIGN:
            return _FOREIGN[name](detail)
    return None


def wrapped(cause: Exception) -> ExtractError:
    """The library's error for any exception; its own errors stay as they are, those raised in tasks come back as what they were."""
    import json
    import zipfile

    if isinstance(cause, ExtractError):
        return cause
    if isinstance(cause, json.JSONDecodeError):
        return JsonParsingError(str(cause))
    if isinstance(cause, zipfile.BadZipFile):
        return ArchiveError(str(cause))
    if isinstance(cause, OSError):
        return SourceIOError(str(cause))
    return ("Traceback" in str(cause) and _of_task(str(cause))) or ExtractError()
