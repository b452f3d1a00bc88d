"""Line deduplication by content-defined chunks, with DataFrame functions only.

Each line is hashed; a rolling hash over ROLLING consecutive line hashes ends a chunk where it is divisible by
MODULUS, so boundaries move along with inserted or deleted lines. Chunks of several lines whose hash occurs more
than once are compared byte by byte, and all occurrences of equal chunks but the first are removed.

Boundaries at multiples miss most short passages, whose boundaries lie in their neighbours. With ``windows`` the rolling
hashes of all places are looked up in the whole corpus instead: a boundary is where the hash of two lines that follow each
other occurs once, so a chunk is a longest run of lines of which every two neighbours repeat. It is compared two lines at
a time, so that each line of a repeated run of two lines or more is found, wherever the first copy has its own ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataloom.llm.common import WHITE, Scratch, join_groups, join_some, numbered, sieve, tidy

ROLLING = 2
MODULUS = 3
LEAST_LINES = 2


def chunks(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _lines, _hashes and _chunks: (k, at, n, hash) of each chunk in order; a null text is one empty line."""
    out = docs.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    out = out.withColumn("_hashes", F.transform("_lines", lambda x: F.xxhash64(x)))
    window = lambda i: F.xxhash64(*[F.get("_hashes", i - d) for d in reversed(range(ROLLING))])
    last = F.size("_lines") - 1
    cut = lambda h, i: (i == last) | ((i >= ROLLING - 1) & (F.pmod(window(i), F.lit(MODULUS)) == 0))
    numbered = F.transform("_hashes", lambda h, i: F.when(cut(h, i), i))
    out = out.withColumn("_ends", F.filter(numbered, lambda i: i.isNotNull()))
    start = lambda k: F.coalesce(F.get("_ends", k - 1) + 1, F.lit(0))
    made = lambda e, k: F.struct(
        k.alias("k"), start(k).alias("at"), (e - start(k) + 1).alias("n"), F.xxhash64(F.slice("_hashes", start(k) + 1, e - start(k) + 1)).alias("hash")
    )
    return out.withColumn("_chunks", F.transform("_ends", made)).drop("_ends")


def windows_of(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds _lines and _chunks: (k, at, n, hash) of each line with a character up to the next such line, which overlap."""
    out = docs.withColumn("_lines", F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1))
    numbered = F.transform("_lines", lambda x, i: F.when(F.length(F.regexp_replace(x, WHITE, "")) > 0, i))
    out = out.withColumn("_full", F.filter(numbered, lambda i: i.isNotNull()))
    # blank lines between the two are part of the window, so equal windows are equal bytes
    length = lambda i, k: F.get("_full", k + 1) - i + 1
    made = lambda i, k: F.struct(
        k.alias("k"), i.alias("at"), length(i, k).alias("n"), F.xxhash64(F.slice("_lines", i + 1, F.coalesce(length(i, k), F.lit(1)))).alias("hash")
    )
    return out.withColumn("_chunks", F.filter(F.transform("_full", made), lambda c: c["n"].isNotNull())).drop("_full")


@tidy()
def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", windows: bool = False) -> DataFrame:
    """All columns of ``docs`` with the text that stays, and n_lines, n_removed_lines.

    The first occurrence (smallest id, a null id last; then the row read first, then place) of a repeated chunk stays;
    chunks of one line, and chunks without a character, stay always. A null text stays null. Rows are told apart by a
    number of their own, so ids may repeat. Columns of ``docs`` with the name of an added one are replaced. An empty table
    gives no rows.

    With ``windows``, the lines of each pair of lines that occurred before go (lines without a character between the two
    included), unless the pair shares a line with its first occurrence. The first occurrence of every line stays.
    """
    split = windows_of if windows else chunks
    scratch = Scratch(docs.sparkSession)
    rows = numbered(docs, scratch)
    text = F.col(f"_doc.`{text_col}`").cast("string").alias("_text")
    base = split(rows.select("_row", F.col(f"_doc.`{id_col}`").alias("_id"), text), "_text")
    # explode() would add a filter on the array, which Spark moves down and so evaluates inside its own lambdas
    several = base.select("_row", "_id", "_lines", F.explode_outer("_chunks").alias("c")).where(F.col("c.n") >= LEAST_LINES)
    piece = F.array_join(F.slice("_lines", F.col("c.at") + 1, F.col("c.n")), "\n")
    repeated = several.select(F.col("c.hash").alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("hash")
    place = F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), F.col("_row").alias("row"), F.col("c.k").alias("k")).alias("place")
    suspects = sieve(several.withColumn("hash", F.col("c.hash")), "hash", scratch.write(repeated)).select(place, piece.alias("piece"))
    suspects = suspects.where(F.length(F.trim("piece")) > 0)
    copies = scratch.write(suspects.select("place.row", "place.k", F.unhex(F.sha2("piece", 256)).alias("sha")))
    groups = suspects.groupBy("piece").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("m")).where("m > 1")
    groups = scratch.write(groups.select(F.unhex(F.sha2("piece", 256)).alias("sha"), "first", "m"))
    found = join_groups(copies, groups, ["sha"], "m", copies.count()).where(F.col("first").isNotNull())
    ahead = F.col("k") - F.col("first.k")
    own = (F.col("row") == F.col("first.row")) & (ahead.isin(0, 1) if windows else ahead == 0)
    removed = scratch.write(found.where(~own).groupBy(F.col("row").alias("_row")).agg(F.collect_set("k").alias("_gone")))
    marked = split(join_some(rows, removed, "_row").withColumn("_text", text), "_text")
    kept_columns = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    if windows:
        gone = F.filter(F.transform("_gone", lambda k: F.get("_chunks", k)), lambda c: c.isNotNull())
        gone = F.array_distinct(F.flatten(F.transform(gone, lambda c: F.sequence(c["at"], c["at"] + c["n"] - 1))))
        marked = marked.withColumn("_lost", F.when(F.col("_gone").isNotNull(), gone))
        places = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_lost"))
        marked = marked.withColumn("_left", F.transform(places, lambda i: F.get("_lines", i)))
        left, lost = F.array_join("_left", "\n"), F.size("_lost")
    else:
        left, lost = _rest_of_chunks()
    whole = F.col("_gone").isNull()
    marked = marked.withColumn("_n", F.size("_lines").cast("long")).withColumn("_text", F.when(whole, F.col("_text")).otherwise(left)).withColumn("_m", F.when(whole, F.lit(0)).otherwise(lost).cast("long"))
    columns = [(F.col("_text") if c == text_col else F.col(f"_doc.`{c}`")).alias(c) for c in kept_columns]
    out = scratch.write(marked.select(*columns, F.col("_n").alias("n_lines"), F.col("_m").alias("n_removed_lines")))
    scratch.drop(keep=1)
    return out


def _rest_of_chunks():
    """(text of the chunks that stay, number of lines that go) of rows with _chunks, _lines and _gone."""
    stays = F.filter("_chunks", lambda c: ~F.array_contains("_gone", c["k"]))
    kept = F.transform(stays, lambda c: F.array_join(F.slice("_lines", c["at"] + 1, c["n"]), "\n"))
    lost = F.aggregate(F.filter("_chunks", lambda c: F.array_contains("_gone", c["k"])), F.lit(0), lambda a, c: a + c["n"])
    return F.array_join(kept, "\n"), lost
