"""What the facade raises; the engine itself keeps errors as rows."""

from __future__ import annotations


class DocxParserError(RuntimeError):
    """A document couldn't be parsed, or wasn't."""


class DocxFileError(DocxParserError, OSError):
    """The file is missing or no readable archive."""


class DocxFormatError(DocxParserError, ValueError):
    """The archive's comments part holds no markup."""


def raised(kind: str, message: str) -> DocxParserError:
    return {"file": DocxFileError, "format": DocxFormatError}.get(kind, DocxParserError)(message)
