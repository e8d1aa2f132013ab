"""Quality rules from Spark functions alone: counts per document and a log-likelihood ratio.

The ratio compares two multinomials over hashed n-grams of tokens (runs of
letters and digits, runs of symbols): one from trusted documents, one from the
whole corpus.  A document's score is the mean over its n-grams of
log(p_trusted / p_corpus), so it does not grow with length, and one fixed
threshold decides every document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let
from .scratch import stored

#: Hash buckets of the multinomials: the size of every table kept per job.
BUCKETS = 1 << 14
#: Pseudo-count of a bucket.
PRIOR = 0.5
#: Documents whose mean log ratio is below this (in nats per n-gram) are rejected.
THRESHOLD = -0.3
#: Fixed by the task.
MIN_WORDS = 50
_SPACE = " \t\n\x0b\f\r"
_SPLIT = r"[ \t\n\x0B\f\r]+"
_NO_SYMBOLS = "[^#*$%&|<>]+"
# Runs of letters, digits and all beyond ASCII, or runs of ASCII symbols.  The classes list single characters,
# which the regular expressions of the JVM look up in a table; ranges they try one after another.
_SYMBOLS = "".join(rf"\x{i:02X}" for i in range(0x21, 0x7F) if not chr(i).isalnum())
_TOKEN = "[^" + "".join(rf"\x{i:02X}" for i in [*range(0x21), 0x7F]) + _SYMBOLS + "]+|[" + _SYMBOLS + "]+"

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def _words(text: Column) -> Column:
    inner = F.trim(text, F.lit(_SPACE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPLIT))


def _chars_of(text: Column, others: str) -> Column:
    """Code points that are left when runs of ``others`` go."""
    return F.char_length(F.regexp_replace(text, others, "")).cast("long")


def base_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Append the counts of ``BASE`` (existing columns of these names are replaced).

    Windows of three words found twice or more are located in two steps: every
    window's hash is packed with its position into one long and sorted, and the
    few positions whose neighbour agrees in the hash part are compared by their
    words.  That keeps the work at n log n for any text.  Functions of every word
    are kept short, since Spark evaluates lambdas node by node.  A null text has no
    words; it fails the base rules, as does every text under 50 words.
    """
    keep = [c for c in docs.columns if c not in BASE]
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^ \t\x0B\f\r]"))
    d = docs.select(*[F.col(f"`{c}`") for c in keep], _words(t).alias("__w"),
                    _chars_of(t, _NO_SYMBOLS).alias("n_symbols"), lines.alias("__l"))
    rest = [*keep, "n_symbols"]

    def step(df, *new):
        return df.select(*[F.col(f"`{c}`") for c in rest], *new)
    n = F.size("__w")
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(n.cast("long")))) - 1  # mask of the position bits
    w = F.col("__w")
    hashed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(
        F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(F.col("__h")).bitwiseOR(i))
    d = d.select(*[F.col(f"`{c}`") for c in rest], "__w", low.alias("__m"), F.bitwise_not(low).alias("__h"),
                 F.char_length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                 (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"))
    rest += ["word_chars", "n_dup_lines"]
    d = step(d, "__w", "__m", F.when(n > 3, F.sort_array(hashed)).otherwise(F.array().cast("array<long>")).alias("__p"))
    p, m = F.col("__p"), F.col("__m")
    # the sorted neighbour has the same hash if it is not above the last place of this hash
    pairs = F.filter(F.sequence(F.lit(0), n - 4), lambda i: F.get(p, i + 1) <= F.get(p, i).bitwiseOR(m))
    both = F.flatten(F.transform(pairs, lambda i: F.array(*[F.get(p, i + k).bitwiseAND(m).cast("int") for k in (0, 1)])))
    d = step(d, "__w", F.when(n > 3, F.array_distinct(both)).otherwise(F.array().cast("array<int>")).alias("__c"))
    d = step(d, F.size("__w").cast("long").alias("n_words"), F.sort_array(F.transform("__c", lambda i: F.struct(
        F.struct(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("k"), i.alias("i")))).alias("__s"))
    rest += ["n_words"]
    s = F.col("__s")
    d = step(d, F.sort_array(F.transform(F.filter(s, lambda x, i: (x.k == F.get(s, i + 1).k) | (x.k == F.get(s, i - 1).k)),
                                         lambda x: x.i)).alias("__r"))
    r = F.col("__r")
    cover = F.transform(r, lambda x, i: F.when(i == 0, 3).otherwise(F.least(F.lit(3), x - F.get(r, i - 1))).cast("long"))
    d = step(d, F.aggregate(cover, F.lit(0).cast("long"), lambda a, x: a + x).alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).select(*[F.col(f"`{c}`") for c in keep], *BASE)


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(_TOKEN), F.lit(0))


def _bucket(buckets: int, *tokens: Column) -> Column:
    """Hash bucket of a gram; ``buckets`` is a power of two."""
    return F.xxhash64(*tokens).bitwiseAND(F.lit(buckets - 1))


def _gram_rows(docs: DataFrame, text: Column, buckets: int, *more: Column) -> DataFrame:
    """A row for every token unigram and bigram of the texts, with its bucket ``b`` and the columns ``more``."""
    d = docs.select(_tokens(text).alias("__t"), *more)
    rest = d.columns[1:]
    d = d.select(F.inline(F.arrays_zip("__t", F.slice("__t", 2, F.size("__t")))).alias("x", "y"), *rest)
    two = F.when(F.col("y").isNotNull(), _bucket(buckets, F.col("x"), F.col("y")))
    return d.select(F.explode(F.array(_bucket(buckets, F.col("x")), two)).alias("b"), *rest).where("b IS NOT NULL")


def _mean_ratio(text: Column, ratio: Column, buckets: int) -> Column:
    """Mean of ``ratio`` over the buckets of the text's token unigrams and bigrams; 0 without any."""
    def mean(t):
        after = F.greatest(F.size(t) - 1, F.lit(0))
        one = F.aggregate(t, F.lit(0.0), lambda a, x: a + F.get(ratio, _bucket(buckets, x)))
        two = F.zip_with(F.slice(t, 1, after), F.slice(t, 2, after), lambda x, y: F.get(ratio, _bucket(buckets, x, y)))
        return F.when(F.size(t) > 0, F.aggregate(two, one, lambda a, r: a + r) / (F.size(t) + after)).otherwise(F.lit(0.0))
    return let(_tokens(text), mean)


def fit_ratio(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              buckets: int = BUCKETS) -> DataFrame:
    """Stored table of one row: ``ratio``, array of log(p_trusted / p_corpus) per
    bucket.  The corpus counts take every document, the trusted ones every
    document labelled quality 1 (in any of its label rows).  Without trusted
    documents every ratio is 0.
    """
    d = docs.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").alias("__text"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("__id")).where("__id IS NOT NULL").distinct()
    # One way at every size: texts move to the partitions of their ids, where only ids are held in memory, and
    # the trusted ones alone are counted again.
    good_docs = d.where("__id IS NOT NULL AND __text IS NOT NULL").join(trusted.hint("shuffle_hash"), "__id", "left_semi")
    text = F.col("__text")
    found = _gram_rows(d, text, buckets).groupBy("b").agg(F.count("*").alias("all"))
    again = _gram_rows(good_docs, text, buckets).groupBy("b").agg(F.count("*").alias("good"))
    counts = stored(found.join(again, "b", "left").select("b", "all", F.coalesce("good", F.lit(0)).alias("good")), "gram-counts")
    total = counts.agg(F.sum("good").alias("g"), F.sum("all").alias("a")).first()
    good, every = total["g"] or 0, total["a"] or 0

    def p(c, n):
        return F.log((F.coalesce(F.col(c), F.lit(0)) + PRIOR) / (n + PRIOR * buckets))
    ratio = p("good", good) - p("all", every) if good else F.lit(0.0)
    spark = docs.sparkSession
    full = spark.range(buckets).select(F.col("id").alias("b")).join(counts, "b", "left")
    row = full.agg(F.array_sort(F.collect_list(F.struct("b", ratio.alias("r")))).alias("x"))
    return stored(row.select(F.transform("x", lambda x: x.r).alias("ratio")), "ratio")


def judge(docs: DataFrame, ratio: DataFrame, text_col: str = "text", buckets: int = BUCKETS,
          threshold: float = THRESHOLD) -> DataFrame:
    """Append the base counts, ``llr`` (mean log ratio per n-gram, 0 without
    any) and ``kept`` (base rules passed and llr not below the threshold)."""
    mean = _mean_ratio(F.col(f"`{text_col}`"), F.col("__ratio"), buckets)
    plain = docs.drop("llr", "kept")
    scored = plain.withColumn("__ratio", ratio.select("ratio").scalar()).withColumn("llr", mean).drop("__ratio")
    out = base_counts(scored, text_col)
    # The last term is always true.  Being non-deterministic to the optimizer, it keeps a filter on ``kept``
    # above these projections; pushed down, it would repeat their array functions inside one another.
    here = F.monotonically_increasing_id() >= 0
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= threshold) & here)


def apply_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                threshold: float = THRESHOLD) -> DataFrame:
    """Fit on ``docs`` and ``labels`` and judge every document of ``docs``.

    Result: the columns of ``docs`` and ``BASE``, ``llr``, ``kept`` (these
    replace columns of the same names).  Null ids are never trusted; repeated
    rows are judged alike; an empty table gives an empty result.
    """
    return judge(docs, fit_ratio(docs, labels, id_col, text_col), text_col, threshold=threshold)
