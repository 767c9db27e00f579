"""Secret scans by corpus-wide ownership frequency, with DataFrame functions only.

Candidates are values in assignments, access keys, runs of hex digits and bare
strings of mixed case and digits. The hash of each candidate is aggregated over
the corpus by distinct documents (repositories) and distinct sources (owners). A
value that several owners have is a copied example; one that few owners have is
taken for a live credential. Candidates of the first three kinds are always
reported; bare strings only where they look live.

Only documents that a cheap pattern finds go through the extraction, and only
these are ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: At most so many owners have a live value.
MAX_OWNERS = 2
MASK = "[SECRET]"

_NAME = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = "(" + _NAME + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A run of 24 or more that has a digit, a small and a capital letter.
BARE = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])(?=[A-Z0-9_+/-]*[a-z])(?=[a-z0-9_+/-]*[A-Z])[A-Za-z0-9_+/-]{24,}"
KINDS = ("assign", "access", "hex", "bare")
_ANY = "|".join([_NAME + r"[\"']?\x20*[:=]", "AKIA[A-Z0-9]{12}", "[0-9a-f]{32}", BARE])


def _matches(text: Column, kind: int, pattern: str, value_group: int, least: int) -> Column:
    """Of each match in order: code points before it since the last match, its length, whether it counts, and the hash of its value."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)) if value_group else found
    parts = F.arrays_zip(F.split(text, pattern).alias("gap"), found.alias("match"), values.alias("value"))
    rows = F.filter(parts, lambda p: p["match"].isNotNull())
    return F.transform(
        rows,
        lambda p, i: F.struct(
            F.lit(kind).alias("kind"),
            i.alias("nth"),
            F.length(p["gap"]).alias("gap"),
            F.length(p["match"]).alias("size"),
            (F.length(p["value"]) >= least).alias("counts"),
            F.sha2(p["value"].cast("binary"), 256).alias("hash"),
        ),
    )


def flagged(docs: DataFrame) -> DataFrame:
    """The rows that may hold a candidate, each whole as a struct (own), numbered (_row) and written once to the shared folder."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return common.cut(docs.where(F.col("text").rlike(_ANY)).select(own.alias("own"), F.monotonically_increasing_id().alias("_row")))


def spans(rows: DataFrame, owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """_row, kind, start, end, n_owners, n_repositories, live of each candidate of flagged rows.

    Null owners or repositories count together as one. Positions are code points,
    ends exclusive.
    """
    columns, text = rows.schema["own"].dataType.names, F.col("own")["text"]
    every = F.concat(_matches(text, 0, ASSIGN, 2, 8), _matches(text, 1, ACCESS, 0, 16), _matches(text, 2, HEX, 0, 32), _matches(text, 3, BARE, 0, 24))
    own = F.coalesce(F.col("own")[owner].cast("string"), F.lit("")) if owner in columns else F.lit("")
    repo = F.coalesce(F.col("own")[repository].cast("string"), F.lit("")) if repository in columns else F.col("_row").cast("string")
    found = rows.select("_row", own.alias("owner"), repo.alias("repository"), F.explode(every).alias("m")).select("_row", "owner", "repository", "m.*")
    so_far = Window.partitionBy("_row", "kind").orderBy("nth")
    found = found.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("counts")
    found = common.cut(found.select("_row", "owner", "repository", "kind", (F.col("end") - F.col("size")).alias("start"), "end", "hash"))
    # Partial sums first: a value that a third of all documents have is a row per owner and task before it is shuffled.
    owners = found.groupBy("hash", "owner").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_owners"))
    repositories = found.groupBy("hash", "repository").agg(F.lit(1).alias("one")).groupBy("hash").agg(F.count(F.lit(1)).alias("n_repositories"))
    counted = found.join(owners.join(repositories, "hash"), "hash").withColumn("live", F.col("n_owners") <= max_owners)
    return counted.where((F.col("kind") < 3) | F.col("live")).select("_row", "kind", "start", "end", "n_owners", "n_repositories", "live")


def _written(found: Column) -> Column:
    """kind:start:end of sorted (start, kind, end, live) structs, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples of every row.

    A null or empty text has no spans: counts of 0, the hash of the empty string
    and an empty string. Repeated rows are scanned each by itself (they are one
    repository where they share a doc_id).
    """
    rows = docs.select("doc_id", F.col("source") if "source" in docs.columns else F.lit("").alias("source"), "text")
    hit = flagged(rows)
    by_row = spans(hit).groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "live"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,live:boolean>>")
    with_found = hit.select("_row", F.col("own")["doc_id"].alias("doc_id")).join(by_row, "_row", "left").select("doc_id", F.coalesce("found", none).alias("found"))
    rest = rows.where(~F.coalesce(F.col("text").rlike(_ANY), F.lit(False))).select("doc_id", none.alias("found"))
    found = F.col("found")
    base = F.filter(found, lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter(found, lambda s: s["kind"] == k)).cast("long")
    return with_found.unionByName(rest).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"),
        _written(found).alias("spans"),
        F.size(F.filter(found, lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter(found, lambda s: ~s["live"])).cast("long").alias("n_examples"),
    )


def redacted(docs: DataFrame) -> DataFrame:
    """docs, the live spans of each text replaced by MASK (overlapping ones by one); n_chars, where there is one, follows the text.

    Copied examples stay, and so does every row and column, whatever the columns
    are called. A null or empty text holds nothing to replace; repeated rows are
    one repository and change alike; an empty table stays empty.
    """
    hit = flagged(docs)
    live = spans(hit).where("live").select("_row", "start", "end")
    w = Window.partitionBy("_row").orderBy("start", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    pieces = live.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("end") > F.col("before")).select("_row", "before", F.greatest("start", "before").alias("start"), "end", (F.col("start") < F.col("before")).alias("joined"))
    by_row = pieces.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("before", "start", "end", "joined"))).alias("_cut"), F.max("end").alias("_tail"))
    text = F.col("own")["text"]
    piece = lambda s: F.concat(text.substr((s["before"] + 1).cast("int"), (s["start"] - s["before"]).cast("int")), F.when(s["joined"], "").otherwise(MASK))
    changed = F.concat(F.array_join(F.transform("_cut", piece), ""), text.substr((F.col("_tail") + 1).cast("int"), F.length(text)))
    out = hit.join(by_row, "_row", "left").withColumn("_new", F.when(F.col("_cut").isNotNull(), changed).otherwise(text))
    new = {"text": F.col("_new")} | ({"n_chars": F.length("_new").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    rest = docs.where(~F.coalesce(F.col("text").rlike(_ANY), F.lit(False)))
    return rest.unionByName(out.select(*[new.get(c, F.col("own")[c]).alias(c) for c in docs.columns]))
