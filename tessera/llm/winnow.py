"""Document fingerprints by winnowing, in DataFrame functions only.

The hashes of all sequences of ``GRAM`` words are computed, and in each window
of ``WINDOW`` consecutive ones the least is chosen, the rightmost of equal
ones. Chosen hashes are kept with their positions, so any run of
``GRAM + WINDOW - 1`` words that two texts share is matched by at least one
chosen hash of both, at known places.

Cases: a null or empty text has an empty fingerprint; fewer words than a
sequence make one hash, fewer hashes than a window make one choice. Two empty
fingerprints have likeness 1. Texts of any length are fingerprinted whole. Equal ids are
ordered by the text's hash, null ids come last. Other columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 5
WINDOW = 8
LOW = -(1 << 63)


def chosen(text: Column, gram: int = GRAM, window: int = WINDOW) -> list[tuple[str, callable]]:
    """Named steps from a text to its chosen hashes; each is an expression of the columns before.

    A chosen value is a long: 31 bits of hash above 32 bits that fall with the
    position, so that the least value is the least hash furthest right.
    """
    def words(t: Column) -> Column:
        return F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")

    def grams(w: Column) -> Column:
        one = lambda i: F.shiftleft(F.shiftrightunsigned(F.xxhash64(F.slice(w, i, gram)), 33), 32) + (F.lit(4294967295) - i)
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (gram - 1), F.lit(1))), one))

    def choose(g: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.size(g) - (window - 1), F.lit(1)))
        return F.when(F.size(g) == 0, g).otherwise(F.array_distinct(F.transform(at, lambda i: F.array_min(F.slice(g, i, window)))))

    return [("words", words), ("grams", grams), ("chosen", choose)]


def with_fingerprint(df: DataFrame, text: str, prefix: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Add ``<prefix>hashes`` (distinct chosen hashes, int) and ``<prefix>positions`` (first word of each choice)."""
    at = F.coalesce(F.col(text), F.lit(""))
    for name, step in chosen(at, gram, window):
        df = df.withColumn(f"_{prefix}{name}", step(at))
        at = F.col(f"_{prefix}{name}")
    df = df.withColumn(f"{prefix}hashes", F.array_distinct(F.transform(at, lambda x: F.shiftright(x, 32).cast("int"))))
    df = df.withColumn(f"{prefix}positions", F.transform(at, lambda x: F.lit(4294967294) - F.pmod(x, F.lit(4294967296))))
    return df.drop(*(f"_{prefix}{n}" for n in ("words", "grams", "chosen")))


def fingerprint_digest(hashes: Column) -> Column:
    """A fixed-length name of a whole fingerprint."""
    return F.sha2(F.array_join(hashes.cast("array<string>"), ","), 256)


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two fingerprints."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, F.lit(1.0)).otherwise(both / total).cast("double")


def _bucket(key: Column, bounds: list[int], at: int = 0) -> Column:
    """Number of bounds that are not above the key, by halving."""
    if not bounds:
        return F.lit(at)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], _bucket(key, bounds[:mid], at)).otherwise(_bucket(key, bounds[mid + 1 :], at + mid + 1))


def with_neighbours(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """Deal rows to ranges of ids so that each row's next one, in descending id, is in its range.

    Adds ``_bucket``, ``_ghost``, ``_key`` and ``_tie``. The first row of each
    range also goes, as a ghost, to the range before it (that of the first
    range to the last), so no task sees more than its range.
    """
    spark = df.sparkSession
    parts = min(1024, max(128, 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    df = df.withColumn("_key", F.coalesce(F.col(id_col).cast("long"), F.lit(LOW))).withColumn("_tie", F.xxhash64(text))
    bounds = df.agg(F.percentile_approx("_key", [i / parts for i in range(1, parts)], 10000)).first()[0] or []
    df = df.withColumn("_bucket", _bucket(F.col("_key"), sorted(set(bounds)))).withColumn("_ghost", F.lit(0))
    least = df.groupBy("_bucket").agg(F.max(F.struct(F.col("_key"), -F.col("_tie").cast("decimal(20,0)"))).alias("h")).collect()
    heads = sorted(((r["_bucket"], r["h"][0], int(-r["h"][1])) for r in least), reverse=True)  # ranges of descending ids
    if not heads:
        return df
    before = [(k, t, heads[i - 1][0]) for i, (_, k, t) in enumerate(heads)]
    ghosts = spark.createDataFrame(before, "_key long, _tie long, _to int")
    one = df.join(F.broadcast(ghosts), ["_key", "_tie"]).dropDuplicates(["_key", "_tie", "_to"])
    one = one.select(*(F.col("_to").alias("_bucket") if c == "_bucket" else F.lit(1).alias("_ghost") if c == "_ghost" else F.col(c) for c in df.columns))
    return df.unionByName(one)


def with_next(df: DataFrame, carry: dict[str, str]) -> DataFrame:
    """Add columns of the next row, given what with_neighbours() added, and drop the ghosts.

    ``carry`` maps columns to the names their next values get.
    """
    order = Window.partitionBy("_bucket").orderBy("_ghost", F.desc("_key"), "_tie")
    df = df.withColumns({new: F.lead(old).over(order) for old, new in carry.items()})
    return df.where("_ghost = 0").drop("_key", "_tie", "_bucket", "_ghost")


def compare_edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's fingerprint against that of its edited text and of the next document.

    The edited text has its last half replaced by the beginning of the next
    document, in descending id. Returns doc_id, n_chars, edited_sha256, the
    fingerprints' hashes and positions, near_edited and near_next.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_fingerprint(with_neighbours(rows, "doc_id", "text"), "text", "")
    rows = with_next(rows, {"text": "next_text", "hashes": "next_hashes"})
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    rows = with_fingerprint(rows.select("doc_id", n.cast("long").alias("n_chars"), "edited", "hashes", "positions", "next_hashes"), "edited", "edited_")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "hashes", "positions", "edited_hashes", "edited_positions",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"), likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
