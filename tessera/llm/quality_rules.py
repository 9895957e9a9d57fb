"""Quality rules by distribution divergence, in DataFrame functions only.

Each document's histogram of character classes and its histogram of common words are
compared with the mean histograms of its language (the references) by Jensen-Shannon
distance. The references are one grouped average over all documents; they have one row per
known language and one for the rest, so joining them to the documents is a broadcast of at
most ``len(COMMON_WORDS) + 1`` rows and the documents are never shuffled.

Defined cases: a null text is the empty text, which fails the base rules; a null or unknown
language is compared with the pooled reference of all such documents; a document below the
length guards is not judged by divergence; columns other than ``text`` and ``lang`` are
carried along unread, whatever their names; repeated rows are judged alike; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import INNER, own_columns
from tessera.plans.staging import stage

WHITE = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
PUNCTUATION = ".,;:!?'\"()-"

#: Ten frequent words of each language with a reference of its own.
COMMON_WORDS = {
    "de": ("der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist"),
    "en": ("the", "of", "and", "to", "in", "a", "is", "that", "it", "for"),
    "es": ("de", "la", "que", "el", "en", "y", "a", "los", "del", "se"),
    "fr": ("de", "la", "le", "les", "et", "des", "en", "un", "du", "que"),
}
POOLED = ""

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Divergence is not judged below these lengths.
GUARD_CHARS = 200
GUARD_WORDS = 40
#: A document is rejected when a Jensen-Shannon distance (base 2), or both as the sides of a right
#: angle, exceed limit + allowance / sqrt(words): histograms of short texts vary more.
CLASS_LIMIT = (0.19, 0.5)
WORD_LIMIT = (0.22, 0.6)
JOINT_LIMIT = (0.28, 0.4)

LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Signs of the other character classes in `_class_text`.
_CLASSES = {
    "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "0": "0123456789",
    "_": WHITE,
    "#": SYMBOLS,
    ".": PUNCTUATION,
}
#: Histogram bins: lower case, the classes above, other ASCII characters, characters beyond ASCII.
CLASS_BINS = len(_CLASSES) + 3
WORD_BINS = max(map(len, COMMON_WORDS.values())) + 1



def _class_text(text: Column) -> Column:
    """The text without its lower-case runs, which are most of it; every other ASCII character
    replaced by the sign of its class."""
    known = "".join(_CLASSES.values())
    rest = "".join(chr(c) for c in range(128) if chr(c) not in known + LOWER)
    signs = "".join(sign * len(chars) for sign, chars in _CLASSES.items()) + "~" * len(rest)
    return F.translate(F.regexp_replace(text, f"[{LOWER[0]}-{LOWER[-1]}]+", ""), known + rest, signs)


def _occurrences(text: Column, sign: str) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(sign)))


def _language(lang: Column) -> Column:
    return F.when(lang.isin(*COMMON_WORDS), lang).otherwise(F.lit(POOLED))


def _word_list(language: Column) -> Column:
    """The common words of the row's language; of all languages' first words when pooled."""
    pooled = [w for words in zip(*COMMON_WORDS.values(), strict=True) for w in words]
    pooled = list(dict.fromkeys(pooled))[: WORD_BINS - 1]
    chosen = F.lit(pooled)
    for name, words in COMMON_WORDS.items():
        chosen = F.when(language == name, F.lit(list(words))).otherwise(chosen)
    return chosen


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), 0)


def _measured(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The documents with their words, class counts and common-word counts."""
    i = INNER
    df = docs.withColumns({i + "text": F.coalesce(docs[text], F.lit("")), i + "lang": _language(docs[lang])})
    df = df.withColumns({
        i + "classes": _class_text(F.col(i + "text")),
        i + "words": _words(F.col(i + "text")),
        i + "list": _word_list(F.col(i + "lang")),
    })
    frequent = sorted({w for words in COMMON_WORDS.values() for w in words})
    df = df.withColumn(i + "frequent", F.filter(i + "words", lambda w: w.isin(*frequent)))
    lower = F.char_length(i + "text") - F.char_length(i + "classes")
    counts = [lower, *(_occurrences(F.col(i + "classes"), sign) for sign in (*_CLASSES, "~"))]
    df = df.withColumns({
        i + "n_chars": F.char_length(i + "text"),
        i + "n_words": F.size(i + "words"),
        i + "ascii": F.array(*counts),
        i + "common": F.array(*(
            F.size(i + "frequent") - F.size(F.array_remove(i + "frequent", F.get(i + "list", F.lit(k)))) for k in range(WORD_BINS - 1)
        )),
    })
    total = lambda name: F.aggregate(name, F.lit(0), lambda a, x: a + x)
    return df.withColumns({
        i + "class_bins": F.concat(F.col(i + "ascii"), F.array(F.col(i + "n_chars") - total(i + "ascii"))),
        i + "word_bins": F.concat(F.col(i + "common"), F.array(F.col(i + "n_words") - total(i + "common"))),
    })


def jensen_shannon(bins: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram of counts and a reference of shares."""

    def part(p: Column, q: Column) -> Column:
        return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)

    total = F.greatest(total, F.lit(1))  # an empty text has an empty histogram
    both = F.zip_with(bins, reference, lambda n, q: part(n / total, q) + part(q, n / total))
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda a, x: a + x) / 2))


def _repeat_words(df: DataFrame) -> DataFrame:
    """Words inside a window of five that the text holds twice or more.

    Windows are compared by 64-bit hash. Only a text with a repeated hash is sorted: equal
    windows become neighbours, their positions are put in order, and each adds the words
    that the one before does not cover.
    """
    i, w = INNER, INNER + "words"
    last = F.col(i + "n_words") - WINDOW
    hashed = F.transform(
        F.sequence(F.lit(0), last), lambda k: F.xxhash64(*(F.get(w, k + j) for j in range(WINDOW)))
    )
    df = df.withColumn(i + "hashes", F.when(last > 0, hashed))
    df = df.withColumn(
        i + "sorted",
        F.when(
            F.size(F.array_distinct(i + "hashes")) < F.size(i + "hashes"),
            F.sort_array(F.transform(i + "hashes", lambda h, k: F.struct(h.alias("h"), k.alias("k")))),
        ),
    )
    ordered = F.col(i + "sorted")
    twins = F.zip_with(
        ordered, F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))),
        lambda x, y: F.when(x.getField("h") == y.getField("h"), F.array(x.getField("k"), y.getField("k"))),
    )
    df = df.withColumn(i + "places", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins)))))
    places = F.col(i + "places")
    gaps = F.zip_with(
        places, F.slice(places, 2, F.size(places) - 1), lambda x, y: F.least(F.lit(WINDOW), F.coalesce(y - x, F.lit(WINDOW)))
    )
    covered = F.aggregate(gaps, F.lit(0), lambda a, x: a + x)
    return df.withColumn(i + "n_repeat", F.coalesce(covered, F.lit(0)).cast("long"))


def _features(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """The documents with all measurements that need the text."""
    i = INNER
    df = _repeat_words(_measured(docs, text, lang))
    lines = F.filter(F.split(i + "text", "\n"), lambda x: F.trim(x, F.lit(WHITE)) != "")
    df = df.withColumn(i + "lines", lines)
    white, symbol = (F.get(i + "ascii", F.lit(1 + list(_CLASSES).index(sign))) for sign in "_#")
    fields = {
        "n_words": F.col(i + "n_words"),
        "word_chars": F.col(i + "n_chars") - white,
        "n_symbols": symbol,
        "n_dup_lines": F.size(i + "lines") - F.size(F.array_distinct(i + "lines")),
        "n_repeat_words": F.col(i + "n_repeat"),
    }
    measures = F.struct(
        F.col(i + "lang").alias("language"), F.col(i + "n_chars").alias("n_chars"),
        F.col(i + "class_bins").alias("class_bins"), F.col(i + "word_bins").alias("word_bins"),
        *(value.cast("long").alias(name) for name, value in fields.items()),
    )
    return df.select(*own_columns(docs), measures.alias(i + "measures"))


def _references(measures: DataFrame) -> DataFrame:
    """Mean histograms per language over the measured documents that pass the length guards."""
    m = F.col(INNER + "measures")
    share = lambda bins, k, n: F.round(F.avg(F.get(m[bins], F.lit(k)) / m[n]), 6)
    judgeable = (m["n_chars"] >= GUARD_CHARS) & (m["n_words"] >= GUARD_WORDS)
    return measures.where(judgeable).groupBy(m["language"].alias("language")).agg(
        F.array(*(share("class_bins", k, "n_chars") for k in range(CLASS_BINS))).alias("class_reference"),
        F.array(*(share("word_bins", k, "n_words") for k in range(WORD_BINS))).alias("word_reference"),
    )


def language_references(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Mean histograms per language over every document that passes the length guards:
    columns ``language``, ``class_reference``, ``word_reference``."""
    i = INNER
    df = _measured(docs.select(F.col(text), F.col(lang)), text, lang)
    measures = F.struct(
        F.col(i + "lang").alias("language"), F.col(i + "n_chars").alias("n_chars"), F.col(i + "n_words").alias("n_words"),
        F.col(i + "class_bins").alias("class_bins"), F.col(i + "word_bins").alias("word_bins"),
    )
    return _references(df.select(measures.alias(i + "measures")))


def _verdict(features: DataFrame, references: DataFrame) -> DataFrame:
    """The measured documents with a struct ``_tessera_quality`` in place of the measurements."""
    i, m = INNER, F.col(INNER + "measures")
    refs = references.select(
        F.col("language").alias(i + "ref_lang"), F.col("class_reference").alias(i + "class_ref"), F.col("word_reference").alias(i + "word_ref")
    )
    # one row per known language and one for the rest: broadcast whatever the corpus holds
    df = features.join(F.broadcast(refs), m["language"] == F.col(i + "ref_lang"), "left")
    of_class = jensen_shannon(m["class_bins"], m["n_chars"], F.col(i + "class_ref"))
    of_words = jensen_shannon(m["word_bins"], m["n_words"], F.col(i + "word_ref"))
    df = df.withColumns({i + "class": of_class, i + "word": of_words})
    x, y = F.col(i + "class"), F.col(i + "word")
    limit = lambda pair: pair[0] + pair[1] / F.sqrt(F.greatest(m["n_words"], F.lit(1)))
    far = (x > limit(CLASS_LIMIT)) | (y > limit(WORD_LIMIT)) | (F.sqrt(x * x + y * y) > limit(JOINT_LIMIT))
    judgeable = (m["n_chars"] >= GUARD_CHARS) & (m["n_words"] >= GUARD_WORDS)
    divergent = F.when(judgeable, F.coalesce(far, F.lit(False))).otherwise(False)
    failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    counts = [m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    verdict = F.struct(*counts, failed.alias("base_failed"), divergent.alias("divergent"), (~failed & ~divergent).alias("kept"))
    return df.select(*own_columns(features.drop(i + "measures")), verdict.alias(i + "quality"))


def quality_counts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", lang: str = "lang", references: DataFrame | None = None
) -> DataFrame:
    """Per document: id, base counts, ``base_failed``, ``divergent`` and ``kept``.

    Without given references the texts are measured once: the measurements, a hundred bytes a
    document, are staged, averaged and then judged.
    """
    measured = _features(docs.select(F.col(id), F.col(text), F.col(lang)), text, lang).select(F.col(id), F.col(INNER + "measures"))
    if references is None:
        measured = stage(measured, "quality-measures")
        references = _references(measured)
    return _verdict(measured, references).select(F.col(id), F.col(INNER + "quality.*"))


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", references: DataFrame | None = None) -> DataFrame:
    """The documents that the rules keep, with their own columns. References default to those of
    the documents, taken in a pass of its own that skips the costlier counts."""
    if references is None:
        references = language_references(docs, text, lang)
    judged = _verdict(_features(docs, text, lang), references)
    # a filter would be pushed below the projections, which repeats every measurement inside it;
    # a generator of one row or none stays where it is
    one = F.explode(F.when(F.col(INNER + "quality.kept"), F.array(F.lit(True))))
    return judged.select(*own_columns(docs), one.alias(INNER + "one")).select(*own_columns(docs))
