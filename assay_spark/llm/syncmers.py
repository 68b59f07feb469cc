"""Operator 9: document fingerprints from closed syncmers, in DataFrame functions only.

A text's k-mers are runs of ``k`` units.  The units are the same for texts of
any length: white-space words, those longer than ``LONG`` (no-space scripts,
unbroken runs) cut into characters.  A k-mer is a closed syncmer when the
smallest hash among its inner substrings (single units) is that of its first or
last one: the choice looks at the k-mer alone, so equal passages choose equal
anchors wherever they stand.  The fingerprint is the list of distinct anchors in
text order, each a 32-bit hash as eight hex digits; ``anchors`` gives them with
their unit positions for positional matching.  Two fingerprints' likeness is the
number of shared anchors over the larger count (1 for two empty ones, 0 for an
empty and another).

A text of fewer than ``k`` units has one anchor, the hash of all of them; a
null or empty text has none.  A fingerprint depends on nothing but its text, so
equal texts, edited or not, have equal fingerprints.  Documents
follow one another by (id, text); rows without an id have no place in that
order and count as their own successor.  Extra columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assay_spark.llm.common import stage

K = 4
#: Words of more characters are cut into characters.
LONG = 24
#: Documents per bucket of the id order, and the most buckets there are.
BUCKET_ROWS, MAX_BUCKETS, SEGMENTS = 500, 100_000, 64


def _unit_hashes(text: Column) -> Column:
    words = F.split(text, "[ \\t\\n\\x0B\\f\\r]+")
    cut = F.flatten(F.transform(words, lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))
    units = F.when(text.rlike(f"[^ \\t\\n\\x0B\\f\\r]{{{LONG + 1}}}"), cut).otherwise(words)
    return F.transform(F.array_remove(units, ""), lambda w: F.xxhash64(w))


def _closed(a: Column, i: Column, k: int) -> Column:
    """Is the smallest of ``a[i] .. a[i + k - 1]`` the first or the last?"""
    inner = [F.get(a, i + j) for j in range(1, k - 1)]
    return F.least(F.get(a, i), F.get(a, i + (k - 1))) <= (F.least(*inner) if len(inner) > 1 else inner[0])


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kmer(a: Column, i: Column, k: int) -> Column:
    return F.hash(*[F.get(a, i + j) for j in range(k)])


def anchors(text: Column, k: int = K) -> Column:
    """array<struct<pos int, hash int>>: the closed syncmers and their unit positions."""
    if k < 3:
        raise ValueError("k is 3 or more")

    def of(a: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.when(
            _closed(a, i, k), F.struct(i.alias("pos"), _kmer(a, i, k).alias("hash"))))
        short = F.array(F.struct(F.lit(0).alias("pos"), F.hash(a).alias("hash")))
        return (F.when(F.size(a) >= k, F.filter(all_, lambda x: x.isNotNull()))
                .when(F.size(a) > 0, short).otherwise(F.slice(short, 1, 0)))

    text = F.coalesce(text, F.lit(""))
    return _bind(_unit_hashes(text), of)


def anchor_hashes(text: Column, k: int = K) -> Column:
    """array<int>: the distinct closed syncmers in text order."""
    def of(a: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.when(_closed(a, i, k), _kmer(a, i, k)))
        short = F.array(F.hash(a))
        return (F.when(F.size(a) >= k, F.array_distinct(F.filter(all_, lambda x: x.isNotNull())))
                .when(F.size(a) > 0, short).otherwise(F.slice(short, 1, 0)))

    return _bind(_unit_hashes(F.coalesce(text, F.lit(""))), of)


def as_string(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared anchors over the larger number of anchors, 0 to 1."""
    most = F.greatest(F.size(a), F.size(b))
    return F.when(most == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / most)


def with_next(rows: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Add next_<c> for each carried column: the value of the row that follows by (id, text).

    Rows are dealt by buckets of the id order (quantile segments, cut evenly);
    the first rows of a bucket are also sent to the bucket before it, those of
    the first bucket to the last one, so one shuffle suffices.
    """
    ids = rows.select(F.col(id_col).alias("id")).where(F.col("id").isNotNull())
    cuts = [i / SEGMENTS for i in range(SEGMENTS + 1)]
    n, marks = ids.agg(F.count("*"), F.percentile_approx("id", cuts, 10_000)).first()
    own = rows.where(F.col(id_col).isNull()).select("*", *[F.col(c).alias(f"next_{c}") for c in carry])
    if not n:
        return own
    marks = sorted(set(marks))
    per = max(1, min(MAX_BUCKETS, n // BUCKET_ROWS) // len(marks))
    lo = F.array(*[F.lit(m).cast("bigint") for m in marks])
    seg = F.greatest(F.lit(1), F.size(F.filter(lo, lambda m: m <= F.col("_id"))))
    width = [max(1, -(-(b - a) // per)) for a, b in zip(marks, marks[1:] + [marks[-1] + 1])]
    widths = F.array(*[F.lit(w).cast("bigint") for w in width])

    def bucket(df: DataFrame) -> DataFrame:
        part = F.floor((F.col("_id") - F.get(lo, F.col("_seg") - 1)) / F.get(widths, F.col("_seg") - 1))
        return df.withColumn("_seg", seg).withColumn(
            "_bucket", F.col("_seg") * F.lit(per + 1) + F.least(F.greatest(part, F.lit(0)), F.lit(per))).drop("_seg")

    firsts = bucket(ids.withColumnRenamed("id", "_id")).groupBy("_bucket").agg(F.min("_id").alias("_first"))
    firsts = stage(firsts, "bucket-firsts")  # at most (MAX_BUCKETS + SEGMENTS) rows
    order = Window.partitionBy(F.lit(1)).orderBy("_bucket")
    last = F.max("_bucket").over(Window.partitionBy(F.lit(1)))
    back = firsts.select("_first", F.lag("_bucket").over(order).alias("_before"), last.alias("_last")).select(
        F.col("_first").alias("_id"), F.coalesce("_before", "_last").alias("_bucket"), F.col("_before").isNull().alias("_wrap"))
    main = rows.withColumn("_id", F.col(id_col)).where(F.col("_id").isNotNull())
    real = bucket(main).withColumns({"_wrap": F.lit(False), "_copy": F.lit(False)})
    copy = main.join(F.broadcast(back), "_id").withColumn("_copy", F.lit(True))
    w = Window.partitionBy("_bucket").orderBy("_wrap", "_id", "_copy", text_col)
    both = real.unionByName(copy)
    out = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in carry}).where(~F.col("_copy"))
    return out.drop("_id", "_bucket", "_wrap", "_copy").unionByName(own)


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(id, n_chars, fingerprint) of every text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(id_col, F.length(text).cast("bigint").alias("n_chars"), as_string(anchor_hashes(text, k)).alias("fingerprint"))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness.

    The edited text has the last quarter of its characters replaced by as many
    (or all) first characters of the next document.
    """
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    rows = rows.withColumn("_f", anchor_hashes(F.col("_t"), k))
    rows = with_next(rows, id_col, "_t", ["_t", "_f"])
    rows = rows.withColumn("n_chars", F.length("_t").cast("bigint")).withColumn("_q", F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumn("_e", F.concat(F.substring("_t", F.lit(1), (F.col("n_chars") - F.col("_q")).cast("int")),
                                          F.substring("next__t", F.lit(1), F.col("_q"))))
    rows = rows.withColumn("_g", anchor_hashes(F.col("_e"), k))
    return rows.select(
        id_col, "n_chars", F.sha2(F.col("_e").cast("binary"), 256).alias("edited_sha256"), as_string(F.col("_f")).alias("fingerprint"),
        as_string(F.col("_g")).alias("edited_fingerprint"), likeness(F.col("_f"), F.col("_g")).alias("near_edited"),
        likeness(F.col("_f"), F.col("next__f")).alias("near_next"))
