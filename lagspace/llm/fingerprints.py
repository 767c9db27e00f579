"""Document fingerprints: I-Match, with DataFrame functions only.

A term is a lower-case run of what is neither white space nor ASCII punctuation.
Only terms whose document frequency lies in a band count (an inverse document
frequency between two bounds). A text's distinct terms of the band are sorted
and hashed once for each of several randomised sub-lexicons, which keep a quarter,
a sixteenth, ... of the lexicon; a fingerprint is the row of these hashes, and two
fingerprints are alike in the share of sub-lexicons (those in which either text
has a term) where their hashes agree.

The band bounds the lexicon by itself: a term in a share ``LOW`` of all documents
takes up that share of all distinct (document, term) pairs, so there are at most
mean distinct terms a document / LOW of them, however large the corpus is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

LOW, HIGH = 0.004, 0.05
#: Denominators of the sub-lexicons' shares, and how many sub-lexicons have each.
SHARES = (4, 16, 64, 256)
PER_SHARE = 6
SEGMENTS = 64
_SPLIT = r"[\s\p{Punct}]+"


def terms(text: Column) -> Column:
    """Distinct terms of a text, in order of appearance; the empty text has none."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), _SPLIT)), "")


def band(docs: DataFrame, low: float = LOW, high: float = HIGH) -> list[str]:
    """The lexicon: terms in at least max(2, low * N) and at most max(2, high * N) of the N documents."""
    n = docs.count()
    counts = docs.select(F.explode(terms(F.coalesce(F.col("text"), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return [r.term for r in counts.where(F.col("df").between(max(2, math.ceil(low * n)), max(2, math.floor(high * n)))).select("term").toLocalIterator()]


def fingerprint(df: DataFrame, text: str, name: str, lexicon: list[str]) -> DataFrame:
    """df with the fingerprint of a text column: hashes of the sub-lexicons, joined by '-'; a hash is empty where the text has no term there.

    A text without any term of the band has one hash of all its terms instead, so
    equal texts always have equal fingerprints. Terms and those of the band are
    columns of their own, so that each is computed once a row.
    """
    df = df.withColumn("_terms", terms(F.col(text)))
    df = df.withColumn("_found", F.expr(f"array_sort(filter(_terms, t -> t IN ({_quoted(lexicon)})))") if lexicon else F.array().cast("array<string>"))
    found, parts = F.col("_found"), []
    for i, share in enumerate(s for s in SHARES for _ in range(PER_SHARE)):
        parts.append(F.array_join(F.filter(found, _in_part(i, share)), " "))
    df = df.withColumn("_kept", F.array(*parts))
    hashed = F.transform("_kept", lambda k: F.when(k == "", "").otherwise(F.substring(F.lower(F.hex(F.xxhash64(k))), 1, 8)))
    whole = F.concat(F.lit("all:"), F.md5(F.array_join(F.array_sort("_terms"), " ").cast("binary")))
    return df.withColumn(name, F.when(F.size("_found") > 0, F.array_join(hashed, "-")).otherwise(whole)).drop("_terms", "_found", "_kept")


def _quoted(lexicon: list[str]) -> str:
    """SQL literals of the lexicon: one text to parse is much quicker than a call for each term. Terms hold no punctuation, so there is nothing to escape."""
    return ", ".join(f"'{t}'" for t in lexicon)


def _in_part(i: int, share: int):
    return lambda t: F.pmod(F.xxhash64(t, F.lit(i)), F.lit(share)) == 0


def likeness(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """df with the share of agreeing hashes among the sub-lexicons where either fingerprint has one; equal fingerprints have 1, one of all terms is like none but its equals."""
    df = df.withColumn("_pairs", F.filter(F.arrays_zip(F.split(a, "-").alias("x"), F.split(b, "-").alias("y")), lambda p: (p["x"] != "") | (p["y"] != "")))
    same = F.size(F.filter("_pairs", lambda p: p["x"] == p["y"]))
    apart = F.col(a).startswith("all:") | F.col(b).startswith("all:") | (F.size("_pairs") == 0)
    return df.withColumn(name, F.when(F.col(a) == F.col(b), 1.0).when(apart, 0.0).otherwise(same / F.size("_pairs"))).drop("_pairs")


def with_next(docs: DataFrame, *carried: str) -> DataFrame:
    """docs (doc_id, text, ...) with next_<name> of each carried column, from the next row by ascending doc_id (ties by text; null ids first; after the last row: the first).

    Rows are dealt by stretches of ids: quantiles cut the ids into segments, equal
    widths cut these again, into about sqrt(N) stretches of about sqrt(N) rows.
    Each stretch also gets the first row of the one after it, so one shuffle is
    enough; only the first ids of the stretches are broadcast, at most
    sqrt(N) + SEGMENTS of them.
    """
    ids = docs.select(F.col("doc_id").cast("double").alias("d"))
    stats = ids.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("d", [i / SEGMENTS for i in range(SEGMENTS + 1)], 10_000).alias("q")).first()
    bounds = sorted(set(stats.q)) if stats.q else [0.0]
    fine = max(1, math.isqrt(stats.n) // max(1, len(bounds) - 1), stats.n // 256 // max(1, len(bounds) - 1) if stats.n < 1 << 16 else 1)
    d = F.col("doc_id").cast("double")
    low = F.array(*[F.lit(float(b)) for b in bounds])
    segment = F.size(F.filter(low, lambda b: b <= d))
    start = F.coalesce(F.get(low, segment - 1), F.lit(bounds[0]))
    end = F.coalesce(F.get(low, segment), F.lit(bounds[-1] + 1))
    step = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(fine - 1.0), (d - start) / F.greatest(end - start, F.lit(1.0)) * fine)))
    dealt = docs.withColumn("_stretch", F.coalesce(segment * fine + step, F.lit(-1)).cast("long"))
    firsts = dealt.groupBy("_stretch").agg(F.min("doc_id").alias("_first")).toPandas().sort_values("_stretch")
    if len(firsts) == 0:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in carried])
    # The first row of a stretch is a guest, at the end, in the stretch before it; that of the first stretch in the last.
    into = list(zip(firsts["_stretch"].tolist(), [firsts["_stretch"].tolist()[-1], *firsts["_stretch"].tolist()[:-1]], [None if x != x else int(x) for x in firsts["_first"].tolist()]))
    heads = docs.sparkSession.createDataFrame(into, "_stretch long, _into long, _first long")
    guests = dealt.join(F.broadcast(heads), "_stretch").where(F.col("doc_id").eqNullSafe(F.col("_first"))).withColumn("_stretch", F.col("_into")).drop("_into", "_first")
    every = dealt.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))
    w = Window.partitionBy("_stretch").orderBy("_guest", F.col("doc_id").asc_nulls_first(), "text")
    return every.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in carried]).where("_guest = 0").drop("_guest", "_stretch")


def fingerprinted(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    A null text is empty; null and repeated ids keep their rows. In a table of one
    row the next document is the row itself. An empty table gives no rows.
    """
    texts = common.pick(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    lexicon = sorted(band(texts, low, high))
    own = fingerprint(texts, "text", "fingerprint", lexicon)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next_text", F.lit(1), half))
    out = with_next(own, "text", "fingerprint").select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint")
    out = out.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256))
    out = fingerprint(out, "edited", "edited_fingerprint", lexicon)
    out = likeness(likeness(out, "fingerprint", "edited_fingerprint", "near_edited"), "fingerprint", "next_fingerprint", "near_next")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
