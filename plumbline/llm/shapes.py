"""Bottom-up recognition of source text by the shapes of its bracket groups.

A lexer (one compiled pattern, run in C) turns a text into one character for each token. The innermost bracket
groups are then replaced again and again by one character each, which says as what the group can be read: an
argument list, a block, an array literal. What a group can be depends on its inner characters alone, so that
this is looked up in a memo; code consists of few shapes, and most groups were seen before. A text is valid
source if all groups can be read as something and the rest reads as a list of statements.
"""

from __future__ import annotations

import re
from collections.abc import Callable

INNER = re.compile(r"[(\[{][^()\[\]{}]*[)\]}]")
BRACKETS = re.compile(r"[()\[\]{}]")
BASE = {"(": 0xE000, "[": 0xE400, "{": 0xE800}
BITS = {"(": 9, "[": 4, "{": 6}
CLOSED = {"(": ")", "[": "]", "{": "}"}
MEMO_SIZE = 400_000


class Invalid(Exception):
    """The text is not valid source."""


def group_class(kind: str, flag: int) -> str:
    """A regular-expression class of all groups of a kind that can be read as ``flag``."""
    chars = [BASE[kind] + f for f in range(1 << BITS[kind]) if f & flag]
    runs: list[list[int]] = []
    for c in chars:
        if runs and c == runs[-1][1] + 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]"


def flags_of(char: str, kind: str) -> int:
    """The flags of a group's character, 0 if it is no group of this kind."""
    f = ord(char) - BASE[kind]
    return f if 0 <= f < 1 << BITS[kind] else 0


class Codes(dict):
    """Token text to code; tokens not met before are classified once."""

    def __init__(self, classify: Callable[[str], str], fixed: dict[str, str]):
        super().__init__(fixed)
        self.classify, self.fixed = classify, fixed

    def __missing__(self, token: str) -> str:
        if len(self) > MEMO_SIZE:
            self.clear()
            self.update(self.fixed)
        code = self.classify(token)
        if len(token) < 200:
            self[token] = code
        return code


class Reducer:
    """Replaces groups by their readings; ``read`` gives the flags of (kind, inner characters)."""

    def __init__(self, read: Callable[[str, str], int]):
        self.read, self.memo = read, {}

    def one(self, text: str) -> str:
        """The character of a group given with its brackets."""
        known = self.memo.get(text)
        if known is None:
            kind = text[0]
            if text[-1] != CLOSED[kind]:
                raise Invalid("brackets don't match")
            flags = self.read(kind, text[1:-1])
            if not flags:
                raise Invalid("a group reads as nothing")
            known = chr(BASE[kind] + flags)
            if len(text) < 2000:
                if len(self.memo) > MEMO_SIZE:
                    self.memo.clear()
                self.memo[text] = known
        return known

    def reduce(self, text: str) -> str:
        replace = lambda m: self.one(m[0])
        for _ in range(60):
            text, n = INNER.subn(replace, text)
            if not n:
                break
        else:
            text = self.deep(text)
        if BRACKETS.search(text):
            raise Invalid("a bracket is left open")
        return text

    def deep(self, text: str) -> str:
        """The same in one pass with a stack, for texts nested very deeply."""
        stack: list[list[str]] = [[]]
        for c in text:
            if c in "([{":
                stack.append([c])
            elif c in ")]}":
                if len(stack) < 2:
                    raise Invalid("a bracket closes nothing")
                inner = "".join(stack.pop()) + c
                stack[-1].append(self.one(inner))
            else:
                stack[-1].append(c)
        if len(stack) > 1:
            raise Invalid("a bracket is left open")
        return "".join(stack[0])


TERNARY = re.compile(r"\?([^?:,;]*):")
#: The same where a question mark or colon may belong to a type before a block.
TERNARY_TYPED = re.compile("\\?([^?:,;\ue800-\ue83f]*):")


def fold_ternaries(text: str, pattern: re.Pattern = TERNARY) -> str:
    """Conditional operators become plain infix ones, innermost first."""
    while "?" in text:
        text, n = pattern.subn(r"o\1o", text)
        if not n:
            break
    return text


def remembered(f: Callable[[str, str], object], mark: Callable[[str], object] = lambda name: name, most: int = 4096, longest: int = 1 << 15) -> Callable[[str, str], object]:
    """``f(text, name)`` that keeps its latest answers, as releases repeat each other's files; ``mark`` gives all of a name that the answer depends on."""
    known: dict[tuple, object] = {}

    def again(text: str, name: str) -> object:
        if len(text) > longest:
            return f(text, name)
        key = (text, mark(name))
        if key not in known:
            if len(known) >= most:
                known.clear()
            known[key] = f(text, name)
        return known[key]

    return again
