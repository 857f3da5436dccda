"""Secret scan with a random forest against false positives.

DataFrame functions and Spark ML (JVM) only.  Candidates are runs of 16 or
more characters that keys are written in, inside the words of a text, with
the words around them; a leading ``name=`` is cut off and counts as what
stands before.  Where a credential's name and an assignment stand in front,
the value is a candidate from ``SHORT`` characters on, of any characters: in
quotes whole (without spaces), else up to a white space, quote, ``,``, ``;`` or ``&``; in the
word after the assignment, unquoted, only with a character that is no letter.
A forest scores each candidate from

* its length and shares of digits, capitals, distinct characters;
* its character transitions (between letters and digits, between cases);
* dictionary coverage: the share of its letter triples that also occur in the
  commonest words of the corpus (counted over all documents);
* whether it or its word looks like a path, address or name with dots;
* the neighbouring words: a credential's name, an assignment, quotes.

The forest is trained on labelled findings.  ``label_by_rule`` gives them
where nobody has labelled any: known key formats and values assigned to a
credential's name are secrets; plain words, numbers, addresses and paths are
not; the rest stays unlabelled.  Training uses at most ``MAX_TRAIN`` findings
of each label, those of smallest hash; everything else covers all documents.

Cases: null and empty texts have no candidates; a text of any length is
scanned whole; repeated candidates and rows are scored each; if the findings
have one label or none, every candidate of the rule's label 1 is kept with
score 1 and the others with score 0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .io import table

#: Most labelled findings of each label that the forest is fitted on.
MAX_TRAIN = 4096
DICTIONARY = 1000
LEAST = 16
SHORT = 8
_RUN = r"[A-Za-z0-9+/_=.\-]{16,}"
#: Beginnings of well-known key formats.
FORMATS = r"^(AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_\-]{35}|eyJ[A-Za-z0-9_\-]{10,}\.[A-Za-z0-9_\-]+)"
NAMES = r"(?i)(token|secret|passw|api.?key|access.?key|auth|credential)"

FEATURES = ["length", "digits", "upper", "distinct", "kind_changes", "case_changes", "hex", "coverage", "path", "dots", "name_near", "assigned", "quoted", "words_near"]


#: A name in front of a value; padding at the end of a value is none.
_NAMED = r"^[A-Za-z_][A-Za-z0-9_.\-]*=(?=[^=])"
_ASSIGN = NAMES + r"""[\w.\-]*["'`\])]*\s*[=:]+>?\s*"""
#: Quoted or bare, in the word of the name itself.
_IN_WORD = _ASSIGN + r"""(?:"([^"]{8,})"|'([^']{8,})'|`([^`]{8,})`|["'`]?([^\s"'`,;&]{8,}))"""
_QUOTED = r"""^(?:"([^"]{8,})"|'([^']{8,})'|`([^`]{8,})`)"""
_BARE = r"""^(?=[A-Za-z]*[^A-Za-z\s"'`,;&.])([^\s"'`,;&]{8,})"""


def _first(text: Column, pattern: str, *groups: int) -> Column:
    """The first group that is not empty, or an empty text."""
    return F.concat(*[F.regexp_extract(text, pattern, g) for g in groups])


def candidates(docs: DataFrame) -> DataFrame:
    """``doc_id, place, candidate, before, around``: place is the number of the
    word (from 0), before the two words and the part of the word in front."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = docs.where(text.rlike(_RUN) | text.rlike(_ASSIGN)).select("doc_id", F.split(text, r"\s+").alias("words"), text.rlike(_ASSIGN).alias("names"))
    before = lambda w, i: F.concat_ws(" ", F.get(w, i - 2), F.get(w, i - 1))
    near = lambda w: F.transform(
        F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (F.length(F.get(w, i)) >= LEAST) | (F.col("names") & (F.length(F.get(w, i)) >= SHORT) & F.concat_ws(" ", before(w, i), F.get(w, i)).rlike(_ASSIGN))),
        lambda i: F.struct(i.alias("place"), F.get(w, i).alias("word"), before(w, i).alias("before"), F.coalesce(F.get(w, i + 1), F.lit("")).alias("after")),
    )
    found = words.select("doc_id", F.inline(F.get(F.transform(F.array("words"), near), F.lit(0))))
    # a value assigned to a credential's name, in this word or by the words before
    follows = F.when(F.col("before").rlike(_ASSIGN + "$"), F.concat(_first(F.col("word"), _QUOTED, 1, 2, 3), F.when(~F.col("word").rlike(_QUOTED), F.regexp_extract("word", _BARE, 1)).otherwise(F.lit("")))).otherwise(F.lit(""))
    own = _first(F.col("word"), _IN_WORD, 2, 3, 4, 5)
    found = found.withColumn("value", F.when(own != "", own).otherwise(follows))
    runs = F.transform(F.regexp_extract_all("word", F.lit(_RUN), F.lit(0)), lambda r: F.regexp_replace(r, _NAMED, ""))
    # a run inside the value is the value's
    runs = F.filter(runs, lambda r: (F.length(r) >= LEAST) & ((F.col("value") == "") | ~F.col("value").contains(r)))
    each = found.select("*", F.explode(F.concat(F.filter(F.array("value"), lambda v: v != ""), runs)).alias("candidate"))
    front = F.expr("substring_index(word, candidate, 1)")
    return each.select("doc_id", F.col("place").cast("long").alias("place"), "candidate", F.concat_ws(" ", "before", front).alias("before"), F.concat_ws(" ", "before", "word", "after").alias("around"))


def common_triples(docs: DataFrame, size: int = DICTIONARY) -> list[str]:
    """Letter triples of the ``size`` commonest words of 3 to 12 letters."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), r"[^\p{L}]+"), lambda w: F.length(w).between(3, 12))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    triples = top.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda i: F.substring("word", i, F.lit(3)))).alias("t")).distinct()
    return sorted(r.t for r in triples.collect())  # at most ten for each of ``size`` words


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def features(found: DataFrame, triples: list[str]) -> DataFrame:
    """``found`` with one double column for each of ``FEATURES``."""
    c, n = F.col("candidate"), F.length("candidate").cast("double")
    found = found.withColumn("_letters", F.lower(F.regexp_replace(c, "[^A-Za-z]+", " ")))
    letters = F.col("_letters")
    parts = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(letters) - 2, F.lit(1))), lambda i: F.substring(letters, i, F.lit(3))), lambda t: ~t.contains(" ") & (F.length(t) == 3))
    shared = F.size(F.filter("_triples", lambda t: t.isin(triples))) if triples else F.lit(0)
    found = found.withColumn("_triples", F.array_distinct(parts)).withColumn("_known", shared)
    return found.select(
        "*",
        n.alias("length"),
        (_count(c, "[0-9]") / n).alias("digits"),
        (_count(c, "[A-Z]") / n).alias("upper"),
        (F.size(F.array_distinct(F.split(c, ""))) / n).alias("distinct"),
        ((_count(c, "[0-9](?=[A-Za-z])") + _count(c, "[A-Za-z](?=[0-9])")) / n).alias("kind_changes"),
        ((_count(c, "[a-z](?=[A-Z])") + _count(c, "[A-Z](?=[a-z])")) / n).alias("case_changes"),
        c.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double").alias("hex"),
        (F.col("_known") / F.greatest(F.size("_triples"), F.lit(1))).alias("coverage"),
        F.col("around").rlike(r"://|@|(/[^/ ]+){2,}|\.(com|org|net|html?|php|js)\b").cast("double").alias("path"),
        (_count(c, r"[./\-_]") / n).alias("dots"),
        F.col("around").rlike(NAMES).cast("double").alias("name_near"),
        F.col("before").rlike(r"[=:]\W*$").cast("double").alias("assigned"),
        F.col("before").rlike(r"""["'`]$""").cast("double").alias("quoted"),
        _count(F.col("before"), r"\p{L}{2,}").alias("words_near"),
    ).drop("_letters", "_triples", "_known")


def label_by_rule(rows: DataFrame) -> DataFrame:
    """``rows`` with ``label``: 1, 0 or null."""
    c = F.col("candidate")
    secret = c.rlike(FORMATS) | ((F.col("name_near") == 1) & (F.col("assigned") == 1) & (F.col("digits") > 0))
    plain = c.rlike(r"^[0-9.\-+/=_]+$") | (F.col("path") == 1) | ((F.col("digits") == 0) & ((F.col("coverage") >= 0.5) | (F.col("case_changes") <= 0.1)))
    return rows.withColumn("label", F.when(secret, 1.0).when(plain & (F.col("name_near") == 0), 0.0))


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN, trees: int = 20, depth: int = 6):
    """A forest from rows with ``FEATURES`` and ``label``; None without both
    labels.  At most ``max_train`` rows of each label."""
    mark = F.xxhash64("candidate", "before")
    parts = [labelled.where(F.col("label") == v).select("label", "candidate", "before", *FEATURES).orderBy(mark, *FEATURES).limit(max_train) for v in (0.0, 1.0)]
    sample = table(parts[0].unionByName(parts[1]).select("label", *FEATURES).coalesce(1), "findings")
    if len(sample.groupBy("label").count().collect()) < 2:
        return None
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(sample)
    return RandomForestClassifier(featuresCol="vector", numTrees=trees, maxDepth=depth, seed=11).fit(vectors)


def score(rows: DataFrame, model) -> DataFrame:
    """``rows`` with ``score``, the forest's probability of a secret."""
    if model is None:
        return rows.withColumn("score", F.coalesce("label", F.lit(0.0)))
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="vector").transform(rows))
    return out.withColumn("score", F.get(vector_to_array("probability"), F.lit(1))).drop("vector", "rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """Every candidate of ``docs`` (doc_id, text) with its features, rule label
    and score.  ``labelled``: findings with ``FEATURES`` and ``label``; by
    default the candidates that the rules label."""
    docs = docs.select("doc_id", "text")
    rows = table(label_by_rule(features(candidates(docs), common_triples(docs))), "candidates")
    return score(rows, fit(labelled if labelled is not None else rows.where("label is not null")))
