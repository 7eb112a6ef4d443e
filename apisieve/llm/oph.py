"""Document fingerprints: one-permutation MinHash with optimal densification.

Five-word shingles (whitespace words, lower-cased) are hashed once. The upper
bits of a hash choose one of ``BINS`` bins, the lower ones are its value; each bin
keeps its least value. An empty bin copies that of another one, found by hashing
(bin, attempt); after ``PROBES`` attempts it takes, of the bins that are not
empty, the one of least hash with it, which is where endless probing of a random
permutation would end. Eight low-order bits of each bin are kept, and the likeness
of two fingerprints is corrected for their chance agreement (1/256).

Everything is a DataFrame expression. A document's hashes are joined by one
sentinel for each bin before they are sorted, so that the first entry of every bin
in order is its least value, or the sentinel if the bin is empty.

Defined cases: null texts are empty; texts under five words are one shingle; texts
without words have the empty fingerprint, alike to itself (1) and to no other (0);
repeated rows are each returned, neighbours by text; columns other than doc_id and
text are left out; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS, SHIFT, PROBES, WORDS = 256, 55, 12, 5
LOW = (1 << SHIFT) - 1
#: Rows of a window partition, on average, where neighbours are brought together.
ROWS_A_BUCKET = 2000
#: Beyond so many buckets their heads' ids are shuffled instead of broadcast.
BROADCAST_ROWS = 1_000_000


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: array<tinyint> of BINS entries, or null for texts without words."""
    t = lambda name: f"__{out}_{name}"
    w, h, s, v = t("w"), t("h"), t("s"), t("v")
    keep = df.columns
    df = df.withColumn(w, F.split(F.regexp_replace(F.lower(F.col(text)), r"^[ \t-\r]+|[ \t-\r]+$", ""), r"[ \t-\r]+"))
    df = df.withColumn(h, F.expr(f"transform({w}, x -> xxhash64(x))"))
    sentinels = F.array(*[F.lit((b << SHIFT) | LOW).cast("long") for b in range(BINS)])
    grams = ", ".join(f"get({h}, i + {k})" for k in range(WORDS))
    df = df.withColumn(
        s,
        F.sort_array(
            F.concat(
                F.expr(
                    f"CASE WHEN size({w}) >= {WORDS} THEN transform(sequence(0, size({h}) - {WORDS}), i -> shiftrightunsigned(xxhash64({grams}), 1)) "
                    f"ELSE array(shiftrightunsigned(xxhash64({h}), 1)) END"
                ),
                sentinels,
            )
        ),
    )
    df = df.withColumn(v, F.expr(f"transform(filter({s}, (x, i) -> i = 0 OR shiftright(x, {SHIFT}) <> shiftright(get({s}, i - 1), {SHIFT})), x -> CASE WHEN x & {LOW} = {LOW} THEN NULL ELSE x & {LOW} END)"))
    probes = ", ".join(f"get({v}, cast(xxhash64(b, {a}) & {BINS - 1} AS int))" for a in range(PROBES))
    full = t("full")
    df = df.withColumn(full, F.expr(f"filter(transform({v}, (x, b) -> CASE WHEN x IS NULL THEN NULL ELSE named_struct('b', b, 'x', x) END), y -> y IS NOT NULL)"))
    last = f"array_min(transform({full}, y -> named_struct('r', xxhash64(b, y.b, {PROBES}), 'x', y.x))).x"
    packed = F.expr(f"transform({v}, (x, b) -> cast((coalesce(x, {probes}, {last}) & 255) - 128 AS tinyint))")
    return df.withColumn(out, F.when(F.get(F.col(w), F.lit(0)) != "", packed)).select(*keep, out)


def as_hex(packed: Column) -> Column:
    """Fingerprint as text: two hexadecimal digits a bin; empty for texts without words."""
    digits = F.transform(packed, lambda b: F.lpad(F.hex(b.cast("int") + 128), 2, "0"))
    return F.lower(F.coalesce(F.array_join(digits, ""), F.lit("")))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard likeness of two packed fingerprints, chance agreement taken off."""
    same = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda z: z)) / F.lit(float(BINS))
    fixed = F.greatest(F.lit(0.0), (same - F.lit(1 / 256)) / F.lit(1 - 1 / 256))
    return F.when(a.isNull() & b.isNull(), 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(fixed)


def next_by_id(docs: DataFrame) -> DataFrame:
    """Adds ``fp``, ``next_text`` and ``next_fp``: of the next row in descending doc_id
    (then by text; null ids last); after the last row comes the first.

    Rows are dealt to buckets of neighbouring ids, each a small window, so texts are
    shuffled once. The one row of every bucket whose next lies in another bucket gets
    it from the bucket heads, of which there is one in ROWS_A_BUCKET rows.
    """
    spans = docs.agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("doc_id").alias("n")).first()
    lo, n = spans["lo"] or 0, max(1, spans["n"])
    width = max(1, ((spans["hi"] or 0) - lo + 1) * ROWS_A_BUCKET // n)
    docs = docs.withColumn("bucket", F.coalesce(F.floor((F.col("doc_id") - F.lit(lo)) / F.lit(width)), F.lit(-1)).cast("long"))
    inside = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = with_fingerprint(docs, "text", "fp")
    rows = rows.select("*", F.lead("text").over(inside).alias("lead_text"), F.lead("fp").over(inside).alias("lead_fp"), F.lead(F.lit(True)).over(inside).alias("has_lead"))

    hint = F.broadcast if n // ROWS_A_BUCKET <= BROADCAST_ROWS else (lambda df: df)
    tops = docs.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    # The next lower bucket: within a group of neighbouring buckets by a window of the group; for a
    # group's last one, the first of the next lower group. The one window over all rows sees a row
    # for each group, which is one in ROWS_A_BUCKET squared rows.
    grouped = tops.select("bucket", F.floor(F.col("bucket") / ROWS_A_BUCKET).alias("group"))
    every = Window.partitionBy("all")
    firsts = grouped.groupBy("group").agg(F.max("bucket").alias("first")).withColumn("all", F.lit(0))
    after = firsts.select("group", F.coalesce(F.lead("first").over(every.orderBy(F.col("group").desc())), F.max("first").over(every)).alias("after"))
    lower = F.lead("bucket").over(Window.partitionBy("group").orderBy(F.col("bucket").desc()))
    chain = grouped.withColumn("lower", lower).join(hint(after), "group").select(F.col("bucket").alias("from_bucket"), F.coalesce("lower", "after").alias("bucket"))
    heads = docs.join(hint(tops.withColumnRenamed("bucket", "top_bucket")), (F.col("bucket") == F.col("top_bucket")) & F.col("doc_id").eqNullSafe(F.col("top")))
    heads = heads.select("bucket", "doc_id", "text", F.row_number().over(inside).alias("k")).filter("k = 1").select("bucket", F.col("text").alias("head_text"))
    heads = with_fingerprint(heads, "head_text", "head_fp")
    bridge = chain.join(heads, "bucket").select(F.col("from_bucket").alias("bucket"), "head_text", "head_fp")
    rows = rows.join(bridge, "bucket", "left")
    return rows.select(
        *docs.columns,
        "fp",
        F.when(F.col("has_lead"), F.col("lead_text")).otherwise(F.col("head_text")).alias("next_text"),
        F.when(F.col("has_lead"), F.col("lead_fp")).otherwise(F.col("head_fp")).alias("next_fp"),
    )


def fingerprint_neighbours(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose last half is taken
    from the next document by descending id; see the module's defined cases."""
    docs = docs.select("doc_id", F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = next_by_id(docs)
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    rows = with_fingerprint(rows, "edited", "edited_fp")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
