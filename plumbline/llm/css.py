"""Recognition of style sheets, as far as needed to tell them from other languages."""

from __future__ import annotations

import re

from plumbline.llm.shapes import Invalid

_SKIP = re.compile(r"/\*.*?\*/|\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'", re.S)
_DECLARATION = re.compile(r"\s*[\w*-]+\s*:[^;{}]+|\s*")
_MARKS = re.compile(r"([{};])")


def check(text: str) -> None:
    """Raise ``Invalid`` unless the text is a list of rules with declarations; empty texts are none.

    One pass over the braces and semicolons: what stands before a brace is a selector or an at-rule, what ends with
    a semicolon or a closing brace is a declaration, at the top an at-rule.
    """
    parts, depth, seen = _MARKS.split(_SKIP.sub("", text)), 0, 0
    for before, mark in zip(parts[::2], [*parts[1::2], ""]):
        bare = before.strip()
        if mark == "{":
            if not bare or "<" in bare or "$" in bare:
                raise Invalid("no selector")
            depth, seen = depth + 1, seen + 1
            continue
        fits = not bare or bare.startswith("@") and mark == ";" or depth and _DECLARATION.fullmatch(before)
        if not fits:
            raise Invalid("no declaration")
        if mark == "}":
            depth -= 1
            if depth < 0:
                raise Invalid("a brace closes nothing")
    if depth or not seen:
        raise Invalid("no rule")
