"""Encoding of a corpus with a public byte-level vocabulary, in Spark expressions alone.

Texts are cut into words by the vocabulary's pattern, once, and a word that is itself an entry has its id by one
lookup; the outcome is written to the shared folder. All other distinct words of the corpus are merged once each,
and their ids go back, by number, to the rows they are missing from; other rows are not shuffled.
Bytes are written as pairs of hexadecimal digits, so that a piece is a string and joining pieces is ``concat``.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import salted_lookup
from plumbline.session import stored

#: Where the rank files lie; any function here takes another path.
VOCABULARY = os.environ.get("PLUMBLINE_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")

#: Fixed value: the pattern that cuts texts before merging, with its blanks spelled as Unicode white space.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)

BUCKETS, WORD_BUCKETS = 2048, 2048
NO_MERGE = 2**31 - 1


@lru_cache(maxsize=4)
def _entries(path: str) -> tuple[tuple[str, int], ...]:
    with open(path, "rb") as f:
        return tuple((base64.b64decode(a).hex().upper(), int(b)) for a, b in map(bytes.split, filter(bytes.strip, f)))


def _slotted(entries, buckets: int) -> list[list[tuple[str, int]]]:
    """(text, id) pairs by the place that the text's checksum gives them."""
    slots: list[list[tuple[str, int]]] = [[] for _ in range(buckets)]
    for piece, rank in entries:
        slots[zlib.crc32(piece.encode()) % buckets].append((piece, rank))
    return slots


@lru_cache(maxsize=4)
def _ranks_sql(path: str) -> str:
    """The rank map of pieces in hexadecimal digits, as one foldable expression: an array of maps."""
    return "array(" + ",".join("str_to_map('" + ",".join(f"{p}:{r}" for p, r in s) + "', ',', ':')" for s in _slotted(_entries(path), BUCKETS)) + ")"


@lru_cache(maxsize=4)
def _words_sql(path: str) -> str:
    """The same for entries that are text themselves; control characters, which no entry holds beside others, part them."""
    texts = []
    for piece, rank in _entries(path):
        try:
            word = bytes.fromhex(piece).decode()
        except UnicodeDecodeError:
            continue
        if "\x01" not in word and "\x02" not in word:
            texts.append((word, rank))
    quoted = lambda s: "\x01".join(f"{w}\x02{r}" for w, r in s).replace("\\", "\\\\").replace("'", "\\'")
    return "array(" + ",".join(f"str_to_map('{quoted(s)}', '\x01', '\x02')" for s in _slotted(texts, WORD_BUCKETS)) + ")"


@lru_cache(maxsize=4)
def _pairs_sql(path: str) -> str:
    """Which byte follows which inside any entry: for each first byte 256 digits, 1 where the second may follow."""
    rows = [bytearray(b"0" * 256) for _ in range(256)]
    for piece, _ in _entries(path):
        b = bytes.fromhex(piece)
        for x, y in zip(b, b[1:]):
            rows[x][y] = 49
    return "array(" + ",".join(f"'{r.decode()}'" for r in rows) + ")"


def rank_of(piece: Column, ranks: Column, buckets: int = BUCKETS) -> Column:
    """The id of a piece, null if it is no entry."""
    slot = F.element_at(ranks, (F.pmod(F.crc32(piece), F.lit(buckets)) + 1).cast("int"))
    return F.get(F.transform(F.array(piece), lambda p: slot[p]), 0).cast("int")


def words_of(text: Column) -> Column:
    """The words of a text in order; none for null and empty texts."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))


def hex_of(word: Column) -> Column:
    return F.hex(F.encode(word, "UTF-8"))


def _bind(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def segments(word: Column, pairs: Column) -> Column:
    """The bytes of a word in hexadecimal digits, cut wherever no entry holds the two neighbouring bytes.

    No merge can cross such a place, so the segments' ids, one behind the other, are the word's. Merging is
    quadratic in the length of what is merged; the cut leaves only stretches that entries could cover.
    """
    number = lambda h: F.conv(h, 16, 10).cast("int")
    follows = lambda a, b: F.substring(F.get(pairs, number(a)), number(b) + 1, 1) == "1"
    digits = F.regexp_extract_all(hex_of(word), F.lit(".."), F.lit(0))
    return _bind(digits, lambda p: F.split(F.array_join(F.transform(p, lambda b, i: F.when((i > 0) & ~follows(F.get(p, i - 1), b), F.concat(F.lit(" "), b)).otherwise(b)), ""), " "))


def merge_word(digits: Column, ranks: Column) -> Column:
    """The ids of the bytes written as ``digits``, folded by merging the pair of lowest rank (the first of equals) until none is left.

    The ranks of neighbouring pairs are kept beside the pieces, so that a merge looks up two pairs only.
    """
    def pair(a: Column, b: Column) -> Column:
        return F.coalesce(rank_of(F.concat(a, b), ranks), F.lit(NO_MERGE))

    def state(pieces: Column, pairs: Column) -> Column:
        return F.struct(pieces.alias("p"), pairs.alias("r"), F.when(F.array_min(pairs) < NO_MERGE, F.array_position(pairs, F.array_min(pairs)).cast("int")).otherwise(F.lit(0)).alias("at"))

    none = F.array().cast("array<int>")
    start = _bind(
        F.regexp_extract_all(digits, F.lit(".."), F.lit(0)),
        lambda p: _bind(
            F.struct(p.alias("p"), F.when(F.size(p) > 1, F.transform(F.slice(p, 1, F.size(p) - 1), lambda a, i: pair(a, F.get(p, i + 1)))).otherwise(none).alias("r")),
            lambda s: state(s["p"], s["r"]),
        ),
    )

    def step(acc: Column, _: Column) -> Column:
        p, r, at = acc["p"], acc["r"], acc["at"]
        both = F.concat(F.get(p, at - 1), F.get(p, at))
        merged = F.concat(F.slice(p, 1, at - 1), F.array(both), F.slice(p, at + 2, F.size(p)))
        left = F.when(at > 1, F.array(pair(F.get(p, at - 2), both))).otherwise(none)
        right = F.when(at + 1 < F.size(p), F.array(pair(both, F.get(p, at + 1)))).otherwise(none)
        pairs = F.concat(F.slice(r, 1, F.greatest(at - 2, F.lit(0))), left, right, F.slice(r, at + 2, F.size(r)))
        return F.when(at == 0, acc).otherwise(_bind(F.struct(merged.alias("p"), pairs.alias("r")), lambda s: state(s["p"], s["r"])))

    folded = F.aggregate(F.sequence(F.lit(1), F.greatest((F.length(digits) / 2).cast("int"), F.lit(1))), start, step)
    return F.transform(folded["p"], lambda x: rank_of(x, ranks))


def ranks_column(path: str = VOCABULARY) -> Column:
    return F.expr(_ranks_sql(path))


def dictionary(words: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(word, ids) for the distinct words of a column ``word``.

    Words are dealt to as many tasks as there are cores, as the work on them isn't told by their bytes.
    """
    spark = words.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by "word" itself this would be taken for the aggregate's own shuffle, whose small partitions are joined again
    once = words.select("word").where("word IS NOT NULL").distinct().repartition(n, F.xxhash64("word"))
    cut = once.select("word", _bind(F.expr(_pairs_sql(path)), lambda p: segments(F.col("word"), p)).alias("__s"))
    return cut.select("word", _bind(ranks_column(path), lambda r: F.flatten(F.transform("__s", lambda s: merge_word(s, r)))).alias("ids"))  # the map is in the plan once


def encode(docs: DataFrame, text: str = "text", path: str = VOCABULARY, out: str = "ids", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` (of its columns only ``keep``, if given) with the list of ids of each text.

    Null, empty texts: the empty list. Every row comes back once, repeated rows too; nothing is cut off.
    A row's words are cut and looked up once and kept as ids, with nulls where a word is no entry, and a list of
    those words. Rows without such words are done. The others get a number, which is unique whatever the rows
    repeat; their missing words go to the dictionary under that number, and the ids come back in order.
    """
    names = list(docs.columns if keep is None else keep)
    found = F.transform(words_of(F.col(text)), lambda w: F.struct(rank_of(w, F.expr(_words_sql(path)), WORD_BUCKETS).alias("i"), w.alias("w")))
    parts = _bind(found, lambda p: F.struct(F.transform(p, lambda x: x["i"]).alias("ids"), F.transform(F.filter(p, lambda x: x["i"].isNull()), lambda x: x["w"]).alias("missing")))
    looked = docs.select(*names, parts.alias("__p")).select(*names, F.col("__p.ids").alias("__ids"), F.col("__p.missing").alias("__missing"), F.monotonically_increasing_id().alias("__row"))
    looked = stored(looked, "words")
    plain = looked.where(F.size("__missing") == 0).select(*names, F.col("__ids").alias(out))
    rest = looked.where(F.size("__missing") > 0)
    asked = rest.select("__row", F.posexplode("__missing").alias("__at", "word"))
    told = salted_lookup(asked, dictionary(asked, path), "word", F.xxhash64("__row", "__at"), 8, "inner")
    more = told.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct("__at", "ids"))), lambda x: x["ids"]).alias("__more"))
    return plain.unionByName(rest.join(more, "__row").select(*names, filled(F.col("__ids"), F.col("__more")).alias(out)))


def filled(ids: Column, more: Column) -> Column:
    """``ids`` with its nulls replaced, in order, by the lists of ``more``; linear in the length."""
    holes = F.filter(F.transform(ids, lambda x, i: F.when(x.isNull(), i)), lambda i: i.isNotNull())

    def assembled(h: Column) -> Column:
        begin = lambda j: F.when(j > 0, F.get(h, j - 1) + 1).otherwise(F.lit(0))
        pieces = F.transform(more, lambda m, j: F.concat(F.slice(ids, begin(j) + 1, F.get(h, j) - begin(j)), m))
        tail = F.slice(ids, F.element_at(h, -1) + 2, F.size(ids))
        return F.flatten(F.concat(pieces, F.array(tail)))

    return _bind(holes, assembled)


def decode(ids: Column, path: str = VOCABULARY) -> Column:
    """The text of a list of ids: the entries' bytes joined and read as UTF-8; null for null or unknown ids."""
    entries = sorted((rank, piece) for piece, rank in _entries(path))
    dense = {r: p for r, p in entries}
    pieces = F.split(F.lit(",".join(dense.get(i, "-") for i in range(entries[-1][0] + 1))), ",")
    return F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), "")), "UTF-8")


def counted(docs: DataFrame, text: str = "text", path: str = VOCABULARY, out: str = "tokens", keep: Sequence[str] | None = None) -> DataFrame:
    """``docs`` without its text and with the number of its ids, written to the shared folder, so that the corpus is read once."""
    names = [c for c in docs.columns if c not in (text, out)] if keep is None else list(keep)
    return stored(encode(docs, text, path, "__done", names).select(*names, F.size("__done").alias(out)), "tokens")
