"""Column expressions that bring differently spelled keys to one form. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an author field holds when it names nobody (letters and digits only, lower case).
NOBODY = (
    "", "anonymous", "na", "nil", "noauthor", "nobody", "none", "notavailable", "null", "undefined", "unknown",
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def path_key(c: Column | str) -> Column:
    """Forward slashes, no outer slashes, lower case; null stays null."""
    return F.lower(F.regexp_replace(F.translate(_col(c), "\\", "/"), "^/+|/+$", ""))


def strip_top(c: Column | str) -> Column:
    """Path without its first component where it has more than one."""
    return F.regexp_replace(_col(c), "^[^/]+/(?=.)", "")


def slug_key(c: Column | str) -> Column:
    """Slug without a trailing version, compared without case, outer blanks and the choice of separator.

    A slug that is nothing but a version keeps its text; blank ones become null.
    """
    plain = F.lower(F.regexp_replace(_col(c), r"^[\s\x{a0}]+|[\s\x{a0}]+$", ""))
    short = F.regexp_replace(plain, r"[._-]?v?\d[\d.]*$", "")
    kept = F.when(F.length(short) > 0, short).otherwise(plain)
    key = F.regexp_replace(F.regexp_replace(kept, r"[\s\x{a0}._-]+", "-"), "^-+|-+$", "")
    return F.when(F.length(key) > 0, key).when(F.length(plain) > 0, plain)


def author_key(c: Column | str) -> Column:
    """Letters and digits of an author in lower case; null where the value names nobody."""
    key = F.lower(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]+", ""))
    return F.when(~key.isin(*NOBODY), key)


def label_key(c: Column | str) -> Column:
    """Class label without outer blanks and tabs, in lower case."""
    return F.lower(F.regexp_replace(_col(c), r"^[ \t]+|[ \t]+$", ""))


def uuid_hex(c: Column | str) -> Column:
    """The 32 hexadecimal digits of a UUID in any usual notation, else null."""
    digits = F.lower(_col(c))
    for mark in ("-", "urn:uuid:", "{", "}", " ", "\t", "\r", "\n", "\f"):
        digits = F.replace(digits, F.lit(mark), F.lit(""))
    return F.when((F.length(digits) == 32) & F.unhex(digits).isNotNull(), digits)


def hex_long(c: Column | str) -> Column:
    """16 hexadecimal digits as a signed long."""
    return F.conv(_col(c), 16, -10).cast("long")
