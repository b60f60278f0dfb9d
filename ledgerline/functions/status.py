"""Outcomes and errors."""

from __future__ import annotations


class Status(Exception):
    """An outcome other than OK, as an exception; str() gives `Code: message`."""

    code = "Unknown"

    def __init__(self, message: str = ""):
        super().__init__(message)
        self.message = message

    def __str__(self) -> str:
        return f"{self.code}: {self.message}" if self.message else self.code


class NotFound(Status):
    code = "NotFound"


class Corruption(Status):
    code = "Corruption"


class IOFailure(Status):
    code = "IOError"


class InvalidArgument(Status):
    code = "InvalidArgument"


class Closed(InvalidArgument):
    """The store was closed."""


def to_string(code: str, message: str = "") -> str:
    return "OK" if code == "OK" else f"{code}: {message}" if message else code
