"""Typed errors; each carries a kind, what belongs to it, and a byte position (patches: the operation's index)."""

from __future__ import annotations


class JsonError(ValueError):
    """kind and detail tell errors apart; pos is a byte offset into the text that was read."""

    def __init__(self, kind: str, pos: int | None = None, detail: object = None):
        super().__init__(kind, pos, detail)
        self.kind, self.pos, self.detail = kind, pos, detail

    def __str__(self) -> str:
        said = self.kind if self.detail is None else f"{self.kind}: {self.detail}"
        return said if self.pos is None else f"{said} at index {self.pos}"

    def __eq__(self, other: object) -> bool:
        return type(self) is type(other) and self.args == other.args

    __hash__ = ValueError.__hash__


class ParseError(JsonError):
    """A text that is not JSON, or beyond a limit."""


class PointerError(JsonError):
    """A malformed JSON Pointer, or one that can't index an array."""


class PathError(JsonError):
    """A malformed JSONPath."""


class RegexError(JsonError):
    """A malformed I-Regexp."""


class PatchError(JsonError):
    """A malformed or inapplicable patch; pos is the operation's index, None for the patch as a whole."""

    @property
    def index(self) -> int | None:
        return self.pos
