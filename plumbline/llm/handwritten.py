"""Generated, minified, copied or data files among source files."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from plumbline.llm.shapes import remembered

#: Phrases of generation notices, in lower case; each alone marks a header comment.
NOTICES = (
    "code generated by", "file generated by", "files generated by", "generated file", "generated stub",
    "@generated", "auto-generated by", "autogenerated by", "auto generated by", "automatically generated", "machine generated",
    "machine-generated", "file is generated", "file is auto", "file is autogenerated", "file was generated", "file was auto",
    "was produced by", "automatically created", "created automatically", "generated from", "generated automatically",
    "manual edits will be lost", "changes will be lost", "changes will be overwritten", "will be overwritten", "will be regenerated",
    "instead of changing it", "instead of editing", "do not edit this file", "do not modify", "do not hand edit", "don't edit this file", "<auto-generated",
    "automatisch erzeugt", "automatisch generiert", "nicht von hand", "nicht bearbeiten", "nicht editieren",
    "cree par", "créé par", "cree automatiquement", "généré par", "genere par", "généré automatiquement", "ne pas modifier", "ne pas éditer",
    "generado por", "generado automáticamente", "generado automaticamente", "no editar", "no modificar",
    "gerado por", "gerado automaticamente", "não editar", "nao editar", "generato da", "generato automaticamente", "non modificare",
    "сгенерирован", "не редактировать", "автоматически создан", "自動生成", "編集しないで", "自动生成", "请勿编辑",
)
#: Letters of scripts that set no blanks between words: kana and Han.
UNSPACED = re.compile(r"[\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
LOCKFILES = re.compile(r"(?:^|/)(?:package-lock\.json|npm-shrinkwrap\.json|yarn\.lock|pnpm-lock\.yaml|composer\.lock|gemfile\.lock|poetry\.lock|cargo\.lock)$")

#: Directories that package managers fill, and suffixes that minifiers give.
VENDORED = re.compile(r"(?:^|/)(?:vendor|node_modules|bower_components|third[-_]?party)/")
SHRUNK = re.compile(r"[.-]min\.\w+$|\.(?:bundle|pack)\.js$")
#: The header that makes a file the main file of a plugin.
OWN = re.compile(r"(?im)^[ \t/*#@]*Plugin Name:")

WORD = re.compile(r"\w+")
COMMENT = re.compile(r"/\*.*?\*/|<!--.*?-->|(?<![:'\"\w])(?://|#)[^\n]*", re.S)
HEADER = re.compile(r"﻿?\s*(?:<\?(?:php|=)?)?\s*((?:(?:/\*.*?(?:\*/|\Z)|//[^\n]*|#(?!\[)[^\n]*|<!--.*?(?:-->|\Z))\s*)+)", re.S)
STRING = re.compile(r"'(?:[^'\\]++|\\.)*+'|\"(?:[^\"\\]++|\\.)*+\"|'[^'\n]{200,}|\"[^\"\n]{200,}", re.S)
ENCODED = re.compile(r"[A-Za-z0-9+/=_-]{48,}|(?:\\x[0-9A-Fa-f]{2}){12,}|%(?:[0-9A-Fa-f]{2}%){20,}")
NUMBERS = re.compile(r"(?:(?<![\w$.#])-?(?:0x[0-9A-Fa-f]+|\d+(?:\.\d+)?)(?![\w%])[\s,;|\])\[(>=]*(?:array\()?){6,}")
LETTERS = re.compile(r"[A-Za-z]{2,}")
SIMILAR = 0.8
WINDOW = 5


def notices() -> ahocorasick.Automaton:
    """The automaton of all notices."""
    a = ahocorasick.Automaton()
    for n in NOTICES:
        a.add_word(n, n)
    a.make_automaton()
    return a


class Library:
    """Word shingles of the library files: what share of a text's shingles is in one of them.

    Words the library doesn't know cannot be part of a shared shingle, so shingles are numbers made of the
    library's word numbers, and a text is looked up by array operations.
    """

    def __init__(self, texts: list[str]):
        self.number: dict[str, int] = {}
        parts = []
        for k, t in enumerate(texts):
            for w in WORD.findall(t):
                self.number.setdefault(w, len(self.number) + 1)
            h = np.unique(self.hashes(t)[0])
            parts.append(np.column_stack([h.view(np.int64), np.full(len(h), k)]))
        table = np.concatenate(parts) if parts else np.zeros((0, 2), np.int64)
        order = np.argsort(table[:, 0].view(np.uint64) if len(table) else table[:, 0], kind="stable")
        self.keys, self.owner = table[order, 0].view(np.uint64) if len(table) else np.zeros(0, np.uint64), table[order, 1]

    def hashes(self, text: str) -> tuple[np.ndarray, int]:
        """Hashes of the shingles whose words are all known, and the number of all shingles."""
        words = WORD.findall(text)
        n = len(words) - WINDOW + 1
        if n < 1:
            return np.zeros(0, np.uint64), 0
        ids = np.fromiter(map(self.number.get, words, [0] * len(words)), np.uint64, len(words))
        if np.count_nonzero(ids) < SIMILAR * n:
            return np.zeros(0, np.uint64), n
        h, known = np.zeros(n, np.uint64), np.ones(n, bool)
        with np.errstate(over="ignore"):
            for i in range(WINDOW):
                part = ids[i : i + n]
                known &= part > 0
                h = h * np.uint64(0x100000001B3) + part * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
        return h[known], n

    def share(self, text: str) -> tuple[float, int]:
        """Greatest share of the text's shingles that one library file has, and the number of shingles."""
        h, n = self.hashes(text)
        if n < 1 or len(h) < SIMILAR * n or not len(self.keys):
            return 0.0, n
        count: Counter[int] = Counter()
        left, right = np.searchsorted(self.keys, h, "left"), np.searchsorted(self.keys, h, "right")
        for width in range(1, int((right - left).max(initial=0)) + 1):
            at = left[(right - left) >= width] + width - 1
            owners, times = np.unique(self.owner[at], return_counts=True)
            count.update(dict(zip(owners.tolist(), times.tolist())))
        return (max(count.values()) / n if count else 0.0), n


def shape(line: str) -> str:
    """A line with its strings, numbers, variables and names left out."""
    s = re.sub(r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"", "S", line)
    s = re.sub(r"//.*", "//", s)
    s = re.sub(r"\$?[A-Za-z_]\w{2,}", "w", s)
    return re.sub(r"-?\b\d[\d.]*\b", "N", s)


ENTRY = re.compile(r"(?:S|N) =>? ?(?:S|N|w),?|S: ?(?:S|N|w),?")
COUNTED = re.compile(r"^\s*['\"][^'\"\n]*?(\d+)['\"]\s*(?:=>|:)", re.M)
ACCESSOR = re.compile(r"function\s+(?:set|get|has|clear|with)_?\w+\s*\([^)]*\)\s*\{\s*(?:return\s+\$this->\w+;|\$this->\w+\s*=\s*\$\w+;(?:\s*return\s+\$this;)?)\s*\}")
_DIGITS, _BLANKS, _CONTROL = b"0123456789", b" \t\n\r", bytes(x for x in range(32) if x not in (9, 10, 12, 13)) + b"\x7f"


def noticed(head: str, automaton: ahocorasick.Automaton) -> bool:
    """Whether a notice stands in the text as whole words, as far as its script separates words."""
    low = head.lower()
    return any(not low[end + 1 : end + 2].isalnum() or UNSPACED.match(low, end) for end, _ in automaton.iter(low))


def repeated(lines: list[str]) -> tuple[str, float]:
    """The most frequent shape of the lines and its share; lines must agree in their first and last character to be looked at."""
    kind_of = lambda c: "0" if c.isdigit() else "a" if c.isalpha() else c
    ends = Counter(kind_of(x[0]) + kind_of(x[-1]) for x in lines)
    if ends.most_common(1)[0][1] < 0.6 * len(lines):
        return "", 0.0
    top, times = Counter(map(shape, lines)).most_common(1)[0]
    return top, times / len(lines)


def counted(text: str) -> bool:
    """Whether the text is mostly a list whose keys end in consecutive numbers, as only programs write."""
    numbers = [int(x) for x in COUNTED.findall(text)]
    steps = sum(b == a + 1 for a, b in zip(numbers, numbers[1:]))
    return len(numbers) >= 10 and steps >= 0.9 * (len(numbers) - 1) and len(numbers) >= 0.7 * text.count("\n")


def path_mark(path: str | None) -> str:
    """What a path says on its own: lockfile, vendored (a package manager's directory), minified (a minifier's suffix), json, css, or nothing."""
    name = (path or "").lower().replace("\\", "/")
    end = name.rsplit(".", 1)[-1]
    marks = [k for k, rule in (("lockfile", LOCKFILES), ("vendored", VENDORED), ("minified", SHRUNK)) if rule.search(name)]
    return " ".join([*marks, *([end] if end in ("json", "css") else [])])


def laid_out(text: str) -> bool:
    """Whether the text is set in lines and blanks, as people write."""
    lines = [x for x in map(str.strip, text.split("\n")) if x]
    return len(lines) >= 4 and max(map(len, lines)) <= 0.4 * len(text) and sum(map(str.isspace, text)) >= 0.12 * len(text)


def kind(text: str, path: str | None, library: Library, automaton: ahocorasick.Automaton) -> str | None:
    """What makes the text no hand-written source: lockfile, binary, vendored, generated, minified or data; None if nothing does.

    The answer depends on the text and on ``path_mark`` of its path, on nothing else. A lockfile's name decides
    alone. A package manager's directory or a minifier's suffix decides unless the text speaks against it: a
    plugin's own main file is not vendored, a text set in lines and blanks is not minified. All else is told by
    the text, of any length. Costly patterns run only where counts of bytes show that they could apply.
    """
    mark = path_mark(path)
    if "lockfile" in mark:
        return "lockfile"
    n, raw = len(text), text.encode("utf-8", "replace")
    size = max(len(raw), 1)
    if n >= 16:
        odd = size - len(raw.translate(None, _CONTROL)) + text.count("\ufffd")
        if odd > 0.03 * n or text.startswith(("GIF8", "PK\x03\x04", "\x89PNG", "%PDF-")):
            return "binary"
    share, shingles = library.share(text)
    if share >= SIMILAR and shingles >= 3:
        return "vendored"
    head = HEADER.match(text)
    if head and noticed(head[1], automaton):
        return "generated"
    if "vendored" in mark and n and not OWN.search(text):
        return "vendored"
    if "minified" in mark and n and not laid_out(text):
        return "minified"
    blanks = (size - len(raw.translate(None, _BLANKS))) / size
    digits = (size - len(raw.translate(None, _DIGITS))) / size
    lines = [x for x in map(str.strip, text.split("\n")) if len(x) > 2]
    longest = max(map(len, lines), default=0)
    if blanks < 0.2 or digits > 0.15 or longest > 0.4 * n:
        code = COMMENT.sub(" ", text)
        plain = STRING.sub('""', code)
        if blanks < 0.2 and sum(map(len, ENCODED.findall(code))) > 0.6 * n:
            return "data"
        if digits > 0.15:
            few = STRING.sub(lambda m: m[0] if NUMBERS.search(m[0]) and len(LETTERS.findall(m[0])) < 3 else '""', code)
            if sum(map(len, NUMBERS.findall(few))) > 0.6 * n:
                return "data"
        if longest > 0.4 * n and sum(map(len, LETTERS.findall(plain))) < 160 and sum(len(x) for x in STRING.findall(code) if len(x) > 200) > 0.8 * n:
            return "data"
        if "json" not in mark and blanks < 0.15:
            rest = plain.split("\n")
            total = sum(map(len, rest))
            dense = sum(len(x) for x in rest if len(x) > 200 and x.count(" ") + x.count("\t") < 0.09 * len(x))
            if dense > 0.5 * total and sum(map(str.isspace, plain)) < 0.12 * total:
                return "minified"
    if len(lines) >= 12 and "css" not in mark and "json" not in mark:
        top, part = repeated(lines)
        if part >= 0.75 and part * len(lines) >= 12:
            if "N, N, N" in top or "N,N,N" in top:
                return "data"
            if not ENTRY.fullmatch(top) or counted(text):
                return "generated"
    if text.count("return $this->") > 4:
        code = COMMENT.sub(" ", text)
        if sum(len(m[0]) for m in ACCESSOR.finditer(code)) > 0.5 * len(code.strip()):
            return "generated"
    return None


def kinds(files: DataFrame, library: list[str]) -> DataFrame:
    """``files`` (path, content and any others) without content, and ``kind``: null for hand-written source.

    The header's notices are found by one automaton for all phrases; path rules tell lockfiles, package managers'
    directories and minifiers' suffixes; copies are told by the share of five-word shingles
    (0.8 or more) that one library file holds, which a cut-off or slightly changed copy keeps; minified and data
    files by how their lines are filled, after comments and strings are taken out, so that one long literal
    in a hand-written file doesn't count. ``library``: the texts of the library's files, a small fixed table.
    Null content gives a null kind, as do empty texts. No shuffle.
    """
    keep = [c for c in files.columns if c not in ("content", "kind")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, automaton = Library(library), notices()
        again = remembered(lambda text, path: kind(text, path, known, automaton), path_mark)
        for b in batches:
            yield b[keep].assign(kind=[None if t is None else again(t, p) for t, p in zip(b["content"], b["path"])])

    return files.select(*keep, "content").mapInPandas(run, f"{fields}, kind string")
