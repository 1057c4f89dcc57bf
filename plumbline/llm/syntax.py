"""Source files that do not parse."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import css, js, php
from plumbline.llm.shapes import Invalid, remembered

#: Which language a name's ending claims.
ENDINGS = {"php": "php", "inc": "php", "phtml": "php", "js": "js", "json": "json", "css": "css"}
#: Languages whose files are judged; the others only serve to recognise wrong endings.
JUDGED = ("php", "js", "json")

# Tokens that are frequent in one language and rare in the others.
HINTS = {
    "php": ("<?php", "<?=", "->", "::", " $", "($", "echo ", "function "),
    "js": ("var ", "let ", "const ", "function(", "function ", "=>", "===", "window.", "document.", "return "),
    "json": ('": ', '":', '{"', '["', "null,", "true,", "false,"),
    "css": ("px;", "px ", "em;", "%;", ": #", ";}", "color:", "{display:", "margin", "padding", " {\n"),
}


def _no_constant(name: str) -> None:
    raise Invalid(name)


def _json(text: str) -> None:
    """Raise ``Invalid`` unless the text is one JSON value; a byte order mark before it is passed over."""
    try:
        json.loads(text[1:] if text[:1] == "﻿" else text, parse_constant=_no_constant)
    except (ValueError, RecursionError) as e:
        raise Invalid(str(e)) from None


GRAMMARS = {"php": php.check, "js": js.check, "json": _json, "css": css.check}


def parses(text: str, language: str) -> str | None:
    """None if the text is valid in the language, else what is wrong."""
    try:
        GRAMMARS[language](text)
    except (Invalid, IndexError, RecursionError) as e:
        return str(e) or "error"
    return None


def ranked(text: str) -> list[str]:
    """All languages, the one whose typical tokens fill most of the text first; ties in the order of the list."""
    score = {k: sum(len(w) * text.count(w) for w in words) for k, words in HINTS.items()}
    return sorted(GRAMMARS, key=lambda k: -score[k])


def judge(text: str, claimed: str | None) -> tuple[bool, str | None, str | None, str | None, list[str]]:
    """(valid, fault, language it is read as, what is wrong, languages that accept it) of one text.

    The languages are ranked by the text's tokens, and every grammar parses the text. If that of the claimed
    language refuses it, the best ranked of those that accept it tells that the name is wrong; if none does, the
    text is damaged. Without a claim, or with one that isn't judged, a text is valid, and the best ranked
    language that accepts it is told all the same. Blank texts are of no foreign language.
    """
    wrong = {k: parses(text, k) for k in ranked(text)}
    accepted = [k for k in wrong if wrong[k] is None and (k == claimed or text.strip())]
    if claimed in accepted or claimed not in JUDGED:
        return True, None, claimed if claimed in accepted else next(iter(accepted), None), None, accepted
    other, why = next(iter(accepted), None), wrong[claimed]
    fault = "no_open_tag" if why == "no opening tag" else "wrong_ending" if other else "damaged"
    return False, fault, other, why, accepted


def claim(path: str) -> Column:
    """The language that a path's ending claims, null for endings not listed."""
    end = F.lower(F.regexp_extract(F.col(path), r"\.([^./\\]*)$", 1))
    claimed = F.lit(None).cast("string")
    for k, v in ENDINGS.items():
        claimed = F.when(end == k, F.lit(v)).otherwise(claimed)
    return claimed


def faults(files: DataFrame) -> DataFrame:
    """``files`` without their content, judged: claimed, valid, fault, parses_as, wrong, accepts; one row for each file.

    Null content: ``valid`` is null and ``fault`` is ``unread``. Empty texts are judged like any other: valid
    JavaScript, no PHP (no opening tag) and no JSON. Names whose ending claims no judged language are valid.
    Nothing is shuffled: each file is parsed where it is read.
    """
    keep = [c for c in files.columns if c not in ("content", "claimed", "valid", "fault", "parses_as", "wrong", "accepts")]
    rows = files.withColumn("claimed", claim("path"))
    names = [*keep, "claimed"]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        again = remembered(judge)
        for b in batches:
            out = []
            for text, claimed in zip(b["content"], b["claimed"]):
                out.append((None, "unread", None, None, None) if text is None else again(text, claimed))
            cols = list(zip(*out)) or [[]] * 5
            yield b[names].assign(valid=pd.array(list(cols[0]), dtype="boolean"), fault=list(cols[1]), parses_as=list(cols[2]), wrong=list(cols[3]), accepts=list(cols[4]))

    return rows.select(*names, "content").mapInPandas(run, f"{fields}, valid boolean, fault string, parses_as string, wrong string, accepts array<string>")


def rates(judged: DataFrame) -> DataFrame:
    """Counts by slug and claimed language: files, unread (as ``zip_errors``), without a tag, with errors, and the rate."""
    error = ~F.coalesce(F.col("valid"), F.lit(True))
    return judged.groupBy("slug", "claimed").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("fault") == "unread").alias("zip_errors"),
        F.count_if(F.col("fault") == "no_open_tag").alias("skipped_no_open_tag"), F.count_if(error & (F.col("fault") != "no_open_tag")).alias("files_with_error"),
        F.count_if(F.col("fault") == "wrong_ending").alias("wrong_ending"), F.count_if(F.col("fault") == "damaged").alias("damaged"),
    ).withColumn("error_rate", F.when(F.col("files") > F.col("zip_errors"), F.col("files_with_error") / (F.col("files") - F.col("zip_errors"))))
