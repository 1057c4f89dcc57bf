"""Keyword-stuffed and link-list pages."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.joins import salted_lookup
from plumbline.session import stored

# Frequent function words of several languages.
FUNCTION_WORDS = frozenset(
    "a an the and or but if of to in on at by for from with without as is are was were be been not no it its this that these those there "
    "you your we our they their he she his her i my me us them who which what when where why how than then so because until only any every each "
    "has have had do does did can could will would should may must after before into over under again all some more most very please "
    "der die das den dem des ein eine einen einem einer und oder aber wenn von zu im in am an auf bei mit nach aus als ist sind war nicht kein keine es wir sie ihr ich "
    "dass wie warum seit für über noch auch nur hat haben wird werden kann jemand "
    "le la les un une des du de et ou mais si dans sur pour par avec sans est sont était ne pas que qui quoi ce cette ces il elle nous vous je mon ma ont a été être plus aussi se sa son au aux en "
    "el los las una unos y o pero sin con por para en al del es son era no se su sus que quien como cuando donde este esta ha han más mi lo le hay ya "
    "и или но не на в во с со к по из за от до для о об у что как это этот эта я мы вы он она они его её их был была есть нет только если при же ли бы после без "
    "il lo gli uno di da che non è sono per più um uma os as não com em e ao".split()
)
URL = re.compile(r"(?:https?://|www\.)[^\s<>\"')\]]+|<a\s[^>]*>|</a>", re.I)
PRICE = re.compile(r"[$€£¥]\s?\d|\b(?:USD|EUR|GBP|JPY|RUB|CHF)\s?\d|\d\s?(?:€|USD|EUR|руб|円|元)", re.I)
TECHNICAL = re.compile(
    r"^\s*(?:#\d+ |\[?\d{1,4}[-:.]\d\d[-:.]\d\d|[=]{1,3} .* [=]{1,3}$|#{1,4} |(?:tags|requires[\w ]*|stable tag|tested[\w ]*|contributors|license|references|class|version)\s*:|>|at [\w.$]+\(|packet \d+)"
    r"|\.(?:php|js|css|inc|phtml|py|java|html?)(?::\d+|\(\d+\)|\s+\|)|\|\s+\d+\s[-+]+|\bline \d+\b|^[-+*`\s]*[a-z]+(?:_[a-z]+)+`?(?:\(\))?\s*(?:[-:].*)?$|[;{}]\s*$|^\s*(?:```|<\?|\$\w+ ?[=-]|//)|^\s*(?:PHP )?(?:warning|notice|error|fatal|debug|info)\b",
    re.I,
)
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
CJK = re.compile(r"[぀-ヿ㐀-鿿가-힯]")
CJK_SENTENCE = re.compile(r"(?:ます|です|ました|ません|ください|でした|ない|した|する|だ|了|的|吗|니다|세요)[。.!！?？]?\s*$")
SENTENCES = re.compile(r"(?<=[.!?。！？…])(?:\s+|(?<=[。！？]))")
HIDDEN = re.compile(r"[​-‏⁠﻿­]")
MIXED = re.compile(r"^(?=.*\d)(?=.*[^\W\d_]).{3,}$")

#: The columns of features, each a number of 0 or more.
FEATURES = (
    "words", "lines", "distinct", "top_word", "top_pair", "function", "ends", "links_per_word", "prices_per_word", "commas_per_word", "mixed",
    "link_part", "price_part", "fragment_part", "stuffed_part", "sentence_part", "technical_part", "spam_part", "spam_of_rest",
)


# What any link and any price of the patterns above holds, in lower case.
LINK_SIGNS = ("http://", "https://", "www.", "<a", "</a")
PRICE_SIGNS = ("$", "€", "£", "¥", "usd", "eur", "gbp", "jpy", "rub", "chf", "руб", "円", "元")
ENDED = re.compile(r"[.!?…][\W_]*$")
CLOSED = re.compile(r"[.!?…]\s*$")
LETTER = re.compile(r"[^\W\d_]")
OPENED = re.compile(r"[\W\d_]*(?:\w+: )?[A-ZÀ-ÞА-ЯЁ¿¡]")
#: Unbroken runs count as this many characters at most in the shares of a page's text.
RUN = re.compile(r"(\S{60})\S+")
STOPS = re.compile(r"[.!?。！？](?:\s|$)")


def holds(low: str, signs: tuple[str, ...]) -> bool:
    return any(x in low for x in signs)


def segment(text: str, technical: bool | None = None, links: bool = True, prices: bool = True) -> str:
    """What a line or sentence is: link, price, technical, sentence, stuffed or fragment.

    ``technical`` tells whether that pattern is known to match; ``links`` and ``prices`` are false where the whole
    page is known to hold none.
    """
    if (TECHNICAL.search(text) if technical is None else technical) and not (prices and PRICE.search(text)):
        return "technical"
    bare = URL.sub(" ", text) if links else text
    linked = len(bare) < len(text)
    priced = prices and PRICE.search(bare) is not None
    if not bare.isascii() and CJK.search(bare) and sum(map(len, CJK.findall(bare))) > 0.3 * len(bare):
        if CJK_SENTENCE.search(bare):
            grams = Counter(bare[i : i + 4] for i in range(len(bare) - 3))
            return "stuffed" if grams and max(grams.values()) >= 3 else "sentence"
        return "price" if priced else "link" if linked else "fragment"
    words = WORD.findall(bare.lower())
    used = sum(map(FUNCTION_WORDS.__contains__, words))
    if len(words) >= 4 and used >= max(1, 0.15 * len(words)):
        ended = ENDED.search(bare) is not None
        if priced and not ended and len(words) < 16:
            return "price"
        if (len(words) < 60 or not ended) and len(set(words)) < len(words):
            pairs = Counter(p for p in zip(words, words[1:]) if not (p[0] in FUNCTION_WORDS and p[1] in FUNCTION_WORDS))
            content = Counter(w for w in words if w not in FUNCTION_WORDS and len(w) > 2)
            if pairs and max(pairs.values()) >= 2 or content and max(content.values()) >= 3:
                return "stuffed"
        if linked and len(words) < (6 if ended else 12):
            return "link"
        return "sentence"
    if priced:
        return "price"
    if linked:
        return "link"
    spoken = len(words) >= 4 and len(set(words)) == len(words) and CLOSED.search(bare) and LETTER.search(bare) and OPENED.match(bare)
    return "sentence" if spoken else "fragment"


class Segments(dict):
    """Kinds of pieces met before: pages share their lines and sentences. Emptied when full, so that memory is bounded."""

    def __init__(self, most: int = 200_000, longest: int = 300):
        super().__init__()
        self.most, self.longest = most, longest

    def __missing__(self, key: tuple[str, bool | None, bool, bool]) -> str:
        kind = segment(*key)
        if len(key[0]) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = kind
        return kind


def features(text: str, known: Segments | None = None) -> tuple[float, ...]:
    """The features of one text, in the order of ``FEATURES``."""
    known = Segments() if known is None else known
    t = text if text.isascii() else HIDDEN.sub(" ", unicodedata.normalize("NFKC", text))
    extent = (lambda x: len(RUN.sub(r"\1", x.strip()))) if RUN.search(t) else lambda x: len(x.strip())
    low = t.lower()
    linked, priced = holds(low, LINK_SIGNS), holds(low, PRICE_SIGNS)
    links = len(URL.findall(t)) if linked else 0
    words = WORD.findall(URL.sub(" ", low) if links else low)
    n = max(len(words), 1)
    part: Counter[str] = Counter()
    lines = [x for x in t.split("\n") if x.strip()]
    fenced = False
    for line in lines:
        if line.lstrip().startswith("```"):
            fenced = not fenced
        if fenced:
            part["technical"] += extent(line)
            continue
        pieces = SENTENCES.split(line)
        technical = len(pieces) <= 3 and TECHNICAL.search(line) is not None  # such a line stays whole, unless it is a paragraph
        if technical or len(pieces) == 1:
            part[known[line, technical, linked, priced]] += extent(line)
            continue
        for p in pieces:
            if p.strip():
                part[known[p, None, linked, priced]] += extent(p)
    size = max(sum(part.values()), 1)
    pairs = Counter(zip(words, words[1:]))
    counts = Counter(words)
    content = max((c for w, c in counts.items() if w not in FUNCTION_WORDS), default=0)
    spam = part["link"] + part["price"] + part["fragment"] + part["stuffed"]
    return (
        float(len(words) + 3 * links), float(len(lines)), len(counts) / n, content / n, max(pairs.values(), default=0) / n,
        sum(c for w, c in counts.items() if w in FUNCTION_WORDS) / n, len(STOPS.findall(t)) / n, links / (n + links), (len(PRICE.findall(t)) if priced else 0) / n,
        (t.count(",") + t.count("、") + t.count("|")) / n, sum(c for w, c in counts.items() if not w.isalpha() and MIXED.match(w)) / n,
        part["link"] / size, part["price"] / size, part["fragment"] / size, part["stuffed"] / size, part["sentence"] / size, part["technical"] / size,
        spam / size, spam / max(size - part["technical"], 1),
    )


def weak_label(f: dict[str, float]) -> int:
    """1 for plainly spam, 0 for plainly not, -1 where the rules abstain."""
    if f["words"] < 10 or f["sentence_part"] > 0.7 or f["technical_part"] > 0.6 and f["spam_part"] < 0.2:
        return 0
    if f["spam_part"] > 0.6 and f["sentence_part"] < 0.4 and f["words"] >= 15 and (f["stuffed_part"] < 0.3 or f["distinct"] < 0.5 or f["top_pair"] > 0.1):
        return 1
    if f["spam_part"] < 0.4:
        return 0
    return -1


def featured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``f`` (the features) and ``weak`` (the weak label) instead of the text; null texts count as empty."""
    keep = [c for c in docs.columns if c not in (text, "f", "weak")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Segments()
        for b in batches:
            rows = [features(t or "", known) for t in b[text]]
            yield b[keep].assign(f=[list(r) for r in rows], weak=pd.Series([weak_label(dict(zip(FEATURES, r))) for r in rows], index=b.index, dtype="int32"))

    return docs.select(*keep, text).mapInPandas(run, f"{fields}, f array<double>, weak int")


def train(rows: DataFrame, most: int = 20_000, trees: int = 20, depth: int = 7, seed: int = 3):
    """Bagged decision trees fitted on at most ``most`` weakly labelled rows, the first by a hash of their features.

    Bagging: every tree sees a bootstrap sample and all features. None if the rows show fewer than two labels.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    sample = rows.where("weak >= 0").select("f", "weak").orderBy(F.xxhash64("f"), "f").limit(most)
    sample = stored(sample.select(array_to_vector("f").alias("features"), F.col("weak").cast("double").alias("label")), "spam-sample")
    if sample.select("label").distinct().count() < 2:
        return None
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="all", bootstrap=True, minInstancesPerNode=3, seed=seed, maxMemoryInMB=128)
    return forest.fit(sample)


def score(docs: DataFrame, host: str = "slug", text: str = "text", weight: float = 0.1, prior: float = 20.0) -> DataFrame:
    """``docs`` without text, with ``page`` (the trees' spam probability), ``host_rate`` and ``score``, their mix.

    The rate of a host is the mean of its pages' probabilities, drawn towards that of all pages as if it had
    ``prior`` more of those; it has ``weight`` in the score. A null host has the rate of all pages. Empty and
    null texts have probability 0, as has everything if the texts show no two weak labels. Repeated rows stay.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = stored(featured(docs, text), "spam-features")
    model = train(rows)
    kept = [c for c in rows.columns if c not in ("f", "weak")]
    if model is None:
        paged = rows.withColumn("page", F.greatest(F.col("weak"), F.lit(0)).cast("double"))
    else:
        paged = model.transform(rows.withColumn("features", array_to_vector("f"))).withColumn("page", vector_to_array("probability")[1])
    paged = paged.select(*kept, F.when(F.get("f", 0) > 0, F.col("page")).otherwise(F.lit(0.0)).alias("page"))
    all_ = paged.agg(F.avg("page")).first()[0] or 0.0
    hosts = paged.where(F.col(host).isNotNull()).groupBy(host).agg(((F.sum("page") + prior * all_) / (F.count(F.lit(1)) + prior)).alias("host_rate"))
    both = salted_lookup(paged, hosts, host, F.xxhash64(*[c for c in kept if c != host], "page"), 8)
    both = both.withColumn("host_rate", F.coalesce("host_rate", F.lit(all_)))
    return both.withColumn("score", (1 - weight) * F.col("page") + weight * F.col("host_rate"))
