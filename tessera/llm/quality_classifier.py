"""Document quality by hierarchical empirical Bayes.

A logistic regression over all words, their beginnings and style marks (hashed into ``BUCKETS``
features, so no term is left out) gives every document its own evidence for a label (good quality, toxic). Sites are estimated from that evidence by grouped
aggregation: the mean of a host is shrunk toward the global mean, that of a path within the
host toward the host's, each by as many pseudo-documents as the spread between sites warrants
(method of moments). The document's odds are then moved by what its path's posterior, without
the document itself, says beyond the global mean.

Fitting uses at most ``FIT_ROWS`` labelled documents, chosen by a hash of their id; everything
else covers all documents. Scores are staged without texts; site posteriors, one row a path,
are broadcast if their measured size allows and otherwise joined on host and path.

Defined cases: a null text is empty and is judged by its style marks; null hosts and paths
are the site ``""``; labels that are null, or whose document is missing, are ignored, and of
several labels of a document the worst counts; with fewer than two classes among the labels
every document has the labels' share as evidence (one half without labels); repeated rows are
judged one by one; other columns are not read; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.plans.staging import broadcast_if, measured, stage

FIT_ROWS = 20_000
#: Features that terms are hashed into, and letters of a word's beginnings, which its inflected forms share.
BUCKETS, STEMS = 1 << 16, (4, 6, 8)
#: Weight of the squared coefficients in a fit.
REGULAR = 1e-3
#: Probabilities are kept this far from 0 and 1.
EDGE = 1e-6
#: Pseudo-documents by which sites are shrunk, at least and at most.
MIN_STRENGTH, MAX_STRENGTH = 4.0, 1e6
BROADCAST_BYTES = 32 * 1024 * 1024
MIN_GOOD, MAX_TOXIC = 0.5, 0.5


def with_terms(df: DataFrame, text: str = "text") -> DataFrame:
    """The table with ``text`` replaced by ``terms``: distinct lower-case words and beginnings of longer ones, and
    style marks in tenths of shares (with a sign no word has).

    Words and distinct words are columns of their own: inside one expression they would be found anew for every use.
    """
    others = [c for c in df.columns if c != text]
    given = df.select(*others, F.coalesce(F.col(text), F.lit("")).alias(text))
    given = given.select("*", F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), 0).alias("words"))
    given = given.select("*", F.array_distinct("words").alias("distinct"))
    share = lambda a, b: F.floor(10 * a / F.greatest(b, F.lit(1))).cast("string")
    length = F.char_length(text)
    letters = length - F.char_length(F.regexp_replace(text, r"\p{L}+", ""))
    marks = F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", ""))
    style = F.array(
        F.concat(F.lit("#letters "), share(letters, length)),
        F.concat(F.lit("#marks "), F.floor(100 * marks / F.greatest(length, F.lit(1))).cast("string")),
        F.concat(F.lit("#distinct "), share(F.size("distinct"), F.size("words"))),
        F.concat(F.lit("#length "), F.floor(F.log2(length + 1)).cast("string")),
    )
    stems = [
        F.transform(F.filter("distinct", lambda w: F.char_length(w) > n), lambda w: F.concat(F.lit("^"), F.substring(w, 1, n))) for n in STEMS
    ]
    return given.select(*others, F.concat("distinct", *stems, style).alias("terms"))


def _hashed(df: DataFrame) -> DataFrame:
    """``terms`` as ``features``, which all labels' models share."""
    return HashingTF(numFeatures=BUCKETS, inputCol="terms", outputCol="features").transform(df).drop("terms")


def _worst_labels(labels: DataFrame, id: str, worst: dict[str, str]) -> DataFrame:
    """One row a labelled document; ``worst`` says whether min or max of a label is the worse."""
    chosen = [getattr(F, how)(F.col(name)).cast("double").alias(name) for name, how in worst.items()]
    return labels.where(F.col(id).isNotNull()).groupBy(F.col(id).alias("labelled")).agg(*chosen)


def fit(docs: DataFrame, labels: DataFrame, worst: dict[str, str], id: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> dict[str, LogisticRegressionModel | float]:
    """A model for every label, or the share of ones where the labels have fewer than two classes."""
    sample = _worst_labels(labels, id, worst).orderBy(F.xxhash64("labelled"), "labelled").limit(rows)
    # at most `rows` ids and labels: broadcast
    given = docs.select(docs[id].alias("id"), docs[text].alias("text")).join(F.broadcast(sample), F.col("id") == F.col("labelled"))
    features = stage(_hashed(with_terms(given.select("text", *worst))), "fit-features")
    models: dict[str, LogisticRegressionModel | float] = {}
    for name in worst:
        known = features.where(F.col(name).isNotNull())
        stats = measured(known, n=F.count("*"), ones=F.sum(name), classes=F.count_distinct(name))
        if stats["classes"] < 2:
            models[name] = stats["ones"] / stats["n"] if stats["n"] else 0.5
            continue
        regression = LogisticRegression(
            featuresCol="features", labelCol=name, maxIter=60, regParam=REGULAR, elasticNetParam=1.0, standardization=False,
            probabilityCol="probability", rawPredictionCol="raw", predictionCol="predicted",
        )
        models[name] = regression.fit(known)
    return models


def evidence(docs: DataFrame, models: dict, host: str | Column, path: str | Column, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``id``, ``host``, ``path`` and a probability for every label."""
    site = lambda c: F.coalesce((docs[c] if isinstance(c, str) else c).cast("string"), F.lit(""))
    df = docs.select(docs[id].alias("id"), site(host).alias("host"), site(path).alias("path"), docs[text].alias("text"))
    df = _hashed(with_terms(df)) if any(not isinstance(model, float) for model in models.values()) else df.drop("text")
    for name, model in models.items():
        if isinstance(model, float):
            df = df.withColumn(name, F.lit(model))
            continue
        df = model.transform(df).withColumn(name, vector_to_array("probability")[1]).drop("probability", "raw", "predicted")
    clipped = lambda c: F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), F.col(c))).alias(c)
    return df.select("id", "host", "path", *(clipped(name) for name in models))


def _strength(sites: DataFrame, mean: float, n: str, total: str) -> float:
    """Pseudo-documents of a beta prior, from the spread of site means beyond binomial noise."""
    m = measured(sites, k=F.count("*"), n=F.sum(n), squares=F.sum(F.col(n) * F.col(n)), spread=F.sum(F.col(n) * F.pow(F.col(total) / F.col(n) - mean, 2)))
    room = m["n"] - m["squares"] / m["n"] if m["n"] else 0
    between = (m["spread"] - (m["k"] - 1) * mean * (1 - mean)) / room if room > 0 else 0.0
    if between <= 0:
        return MAX_STRENGTH
    return min(MAX_STRENGTH, max(MIN_STRENGTH, mean * (1 - mean) / between - 1))


def site_posteriors(scores: DataFrame, name: str) -> tuple[DataFrame, float, float]:
    """Per path: ``n``, ``total`` evidence and ``prior``, the host's posterior; the global mean; and
    the strength of a path's prior."""
    paths = stage(scores.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum(name).alias("total")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("total").alias("host_total"))
    whole = measured(hosts, n=F.sum("host_n"), total=F.sum("host_total"))
    mean = min(1 - EDGE, max(EDGE, whole["total"] / whole["n"])) if whole["n"] else 0.5
    host_strength = _strength(hosts, mean, "host_n", "host_total")
    path_strength = _strength(paths, mean, "n", "total")
    prior = (F.col("host_total") + host_strength * mean) / (F.col("host_n") + host_strength)
    return paths.join(hosts, "host").select("host", "path", "n", "total", prior.alias("prior")), mean, path_strength


def combine(scores: DataFrame, name: str, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The scores with the label's evidence moved by the site's posterior."""
    sites, mean, strength = site_posteriors(scores, name)
    sites = sites.select(F.col("host").alias("site_host"), F.col("path").alias("site_path"), "n", "total", "prior")
    size = measured(sites, size=F.sum(F.octet_length("site_host") + F.octet_length("site_path") + 64))["size"] or 0
    joined = scores.join(
        broadcast_if(sites, size, broadcast_bytes), (F.col("host") == F.col("site_host")) & (F.col("path") == F.col("site_path"))
    )
    p = F.col(name)
    others = (F.col("total") - p + strength * F.col("prior")) / (F.col("n") - 1 + strength)
    others = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), others))
    logit = lambda x: F.log(x / (1 - x))
    moved = 1 / (1 + F.exp(-(logit(p) + logit(others) - logit(F.lit(mean)))))
    return joined.select(*(moved.alias(c) if c == name else F.col(c) for c in scores.columns))


def classify(
    docs: DataFrame, labels: DataFrame, host: str | Column = "source", path: str | Column = "lang", id: str = "doc_id", text: str = "text",
    quality: str = "quality", toxic: str = "toxic", rows: int = FIT_ROWS,
) -> DataFrame:
    """Per document: id, ``good`` and ``bad`` (posterior of quality and toxicity) and ``kept``."""
    models = fit(docs, labels, {quality: "min", toxic: "max"}, id, text, rows)
    scores = stage(evidence(docs, models, host, path, id, text), "quality-evidence")
    scores = combine(combine(scores, quality), toxic)
    good, bad = F.round(quality, 6), F.round(toxic, 6)
    return scores.select(F.col("id").alias(id), good.alias("good"), bad.alias("bad"), ((good >= MIN_GOOD) & (bad < MAX_TOXIC)).alias("kept"))
