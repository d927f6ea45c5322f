"""Problem 1: records that differ only in formatting, collapsed by commutative multiset hashing.

A record's content is its error type's words, its message's words outside named fields in order, and
the multiset of its named fields. Each (name, value) pair is hashed by itself; the hashes are added
up, so the order of the fields cannot matter and nothing has to be sorted. Rows are grouped by that
fingerprint, and every member's fields are then compared with those of its group's first row.

Defined results: a null message counts as its own content, apart from an empty one; a null error type
equals only null; texts of punctuation only have no words and equal each other; repeated fields count
with their multiplicity; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import shuffle_partitions, written

WS = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_WORD = r"[\p{L}\p{M}\p{N}]++"
#: A sign is content directly before a digit and not after a letter or digit; a point between digits.
TOKEN = rf"(?:(?<![\p{{L}}\p{{M}}\p{{N}}])[-\u2212](?=\p{{N}}))?{_WORD}(?:(?<=\p{{N}})\.(?=\p{{N}}){_WORD})*+"
#: name, separator, value; a value that is itself a name (another separator follows) is none.
FIELD = (
    r"(?<![\p{L}\p{M}\p{N}_])(\p{L}[\p{L}\p{M}\p{N}_]*+)[\"'”’]?" + f"{WS}*+[:=]{{1,2}}{WS}*+"
    r"[\"'“‘«(\[{]*+"
    r"([-\u2212]?[\p{L}\p{M}\p{N}]++(?:[._\-][\p{L}\p{M}\p{N}]++)*+)"
    r"(?![\"'”’]?" + f"{WS}*+[:=])"
)
_HALF = 1 << 40


def words(text: Column) -> Column:
    """The text's words joined by one blank; text must be case-folded."""
    return F.array_join(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), " ")


def fold(text: Column) -> Column:
    return F.translate(F.lower(F.upper(text)), "\u2212", "-")


def _total(pairs: Column, seed: int) -> Column:
    """Commutative: a sum of 40-bit hashes, which no text is long enough to overflow."""
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda s, p: s + F.pmod(F.xxhash64(p, F.lit(seed)), F.lit(_HALF)))


def canonical(df: DataFrame, row_id: str = "rowId", error_type: str = "errorType", message: str = "message") -> DataFrame:
    """row_id, et, header and fields (name=value strings, in text order)."""
    text = fold(F.col(message))
    base = df.select(F.col(row_id).alias("row_id"), words(fold(F.col(error_type))).alias("et"), text.alias("_t"))
    names, values = (F.regexp_extract_all("_t", F.lit(FIELD), F.lit(i)) for i in (1, 2))
    base = base.select(
        "row_id", "et", words(F.regexp_replace("_t", FIELD, " ")).alias("header"),
        F.zip_with(names, values, lambda n, v: F.concat(words(n), F.lit("="), words(v))).alias("fields"),
    )
    return base


def fingerprint(rows: DataFrame) -> DataFrame:
    """Adds k1 (words outside the fields) and k2 (the fields as a multiset)."""
    fields = F.col("fields")
    return rows.select(
        "*", F.xxhash64(F.col("et").isNull(), "et", F.col("header").isNull(), "header", F.size("fields")).alias("k1"),
        F.xxhash64(_total(fields, 1), _total(fields, 2)).alias("k2"),
    )


def same_fields(a: Column, b: Column) -> Column:
    """Whether two arrays hold the same multiset: by hash set both ways; only repeated fields are counted."""
    once = (F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0)
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    repeats = F.forall(F.array_distinct(a), lambda x: count(a, x) == count(b, x))
    plain = F.size(F.array_distinct(a)) == F.size(a)
    return (a.isNull() & b.isNull()) | ((F.size(a) == F.size(b)) & once & (plain | repeats))


CONTENT = ("et", "header", "fields")


def _compared(rows: DataFrame) -> DataFrame:
    """row_id, k1, k2, first_row_id, and the content where it is not that of the fingerprint's first row (first_row_id is null).

    The first row and the size of a fingerprint come from a partial aggregate, so a group of any size arrives as one
    row per map task. Rows alone in theirs need no second look. Fingerprints of more than a quarter of a task's share
    (at most four per task) are compared where their rows lie; only the rows of all others move to their first row."""
    tasks = shuffle_partitions(rows.sparkSession)
    total = rows.count()  # from the footers of the written table
    firsts = rows.groupBy("k1", "k2").agg(F.min(F.struct("row_id", *CONTENT)).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    large = F.col("n") * (4 * tasks) > total
    hot = F.broadcast(firsts.where(large).select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.col("f").alias("hf")))
    a = rows.join(hot, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    known = F.col("hf").isNotNull()
    a = a.withColumns({"m1": F.when(known, F.xxhash64("row_id")).otherwise(F.col("k1")), "m3": known})
    cold = firsts.where(~large).select(F.col("k1").alias("m1"), F.col("k2").alias("m2"), F.lit(False).alias("m3"), "f")
    j = a.withColumnRenamed("k2", "m2").join(cold, ["m1", "m2", "m3"], "left").withColumnRenamed("m2", "k2")
    f = F.coalesce("hf", "f")
    equal = F.col("et").eqNullSafe(f["et"]) & F.col("header").eqNullSafe(f["header"]) & same_fields(F.col("fields"), f["fields"])
    j = j.withColumn("first_row_id", F.when(f.isNull(), F.col("row_id")).when(equal, f["row_id"]))
    odd = F.col("first_row_id").isNull()
    return j.select("row_id", "k1", "k2", "first_row_id", *(F.when(odd, F.col(c)).alias(c) for c in CONTENT))


def collapse(df: DataFrame, row_id: str = "rowId", error_type: str = "errorType", message: str = "message") -> DataFrame:
    """One row per input row: row_id, first_row_id (the smallest of its content).

    Members whose content is not that of their fingerprint's first row (a collision of hashes) are compared among
    themselves, again with their first row, until none is left: a turn for each content that shares a fingerprint.
    Nothing is sorted."""
    rows = fingerprint(written(canonical(df, row_id, error_type, message)))
    out = None
    while True:
        seen = written(_compared(rows))
        done = seen.where("first_row_id is not null").select("row_id", "first_row_id")
        out = done if out is None else out.unionAll(done)
        rows = seen.where("first_row_id is null").select("row_id", *CONTENT, "k1", "k2")
        if rows.isEmpty():
            return out


def copies(df: DataFrame, **columns: str) -> DataFrame:
    """first_row_id, copy_row_id: each member of a set of copies with the set's smallest row id."""
    return collapse(df, **columns).where("row_id <> first_row_id").select("first_row_id", F.col("row_id").alias("copy_row_id"))


def records(df: DataFrame, **columns: str) -> DataFrame:
    """One record per distinct content: first_row_id and n_copies (itself included)."""
    return collapse(df, **columns).groupBy("first_row_id").agg(F.count(F.lit(1)).alias("n_copies"))
