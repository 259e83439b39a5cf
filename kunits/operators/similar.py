"""Similar bit signatures: all pairs within a Hamming radius, and groups around leaders.

Small radii are found by multi-index hashing. A signature is cut into more
blocks than the radius; two signatures within it agree on all blocks but as
many as the radius, so they meet in a table keyed by one choice of the others.
Wide radii have no such index: signatures are compared with leaders, round by
round, until none is left uncompared.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kunits.operators.vectors import hamming
from kunits.session import Scratch

BITS = 64
#: Blocks beyond the radius: a key holds as many, so more of them make longer keys and more tables.
SPARE = 3
#: Members of a group that are tried as leaders in one round, at most.
FIRST_LEADERS, MOST_LEADERS = 16, 256


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> BITS - 1 else mask


def key_masks(radius: int, spare: int = SPARE) -> list[int]:
    """Masks of the tables, as signed longs: all choices of *spare* among radius + *spare* blocks of bits."""
    blocks = radius + spare
    if radius < 0 or spare < 1 or blocks > BITS:
        raise ValueError("the radius must leave a bit for each block")
    ends = [BITS * i // blocks for i in range(blocks + 1)]
    bits = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(bits, spare)]


def near_pairs(marks: DataFrame, radius: int, mark: str = "mark", spare: int = SPARE) -> DataFrame:
    """left, right, distance: all pairs of different signatures within *radius* bits, each once, the lesser first.

    *marks* has one row for each signature (repeated ones count once, nulls
    not at all). A pair that meets in several tables is kept in the first, so
    no shuffle is needed to make pairs distinct. Signatures that share a key
    but aren't within the radius are compared and dropped; a key of *spare*
    of radius + *spare* blocks has about 64 * spare / (radius + spare) bits.
    Both sides are shuffled: Spark takes the table before its keys were made
    for its size, and would broadcast all keys of a table that is small itself.
    """
    masks = F.array(*(F.lit(m).cast("long") for m in key_masks(radius, spare)))
    once = marks.select(F.col(mark).cast("long").alias("mark")).where("mark is not null").distinct()
    keyed = once.select("mark", F.posexplode(F.transform(masks, lambda m: F.col("mark").bitwiseAND(m))).alias("nth", "key"))
    a, b = (keyed.select("nth", "key", F.col("mark").alias(side)) for side in ("left", "right"))
    differs = F.col("left").bitwiseXOR(F.col("right"))
    met = a.hint("merge").join(b.hint("merge"), ["nth", "key"]).where(F.col("left") < F.col("right")).where(F.bit_count(differs) <= radius)
    before = F.exists(F.slice(masks, F.lit(1), F.col("nth")), lambda m: differs.bitwiseAND(m) == 0)
    return met.where(~before).select("left", "right", F.bit_count(differs).cast("int").alias("distance"))


def classes(rows: DataFrame, key: str, mark: str = "mark") -> DataFrame:
    """mark, class_id (the least key), n: rows of equal signatures."""
    return rows.groupBy(F.col(mark).alias("mark")).agg(F.min(key).alias("class_id"), F.count("*").alias("n"))


def class_pairs(rows: DataFrame, key: str, radius: int, mark: str = "mark", spare: int = SPARE, scratch: Scratch | None = None) -> DataFrame:
    """left_id, right_id, left_n, right_n, distance: classes of equal signatures within *radius* bits of each other.

    Copies aren't expanded into pairs: a class stands for all its rows. The
    lesser class id is left.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    known = scratch.stored(classes(rows.where(F.col(mark).isNotNull()), key, mark), "mark-classes")
    pairs = near_pairs(known, radius, "mark", spare)
    side = lambda name: known.select(F.col("mark").alias(name), F.struct(F.col("class_id").alias("id"), "n").alias(f"{name}_class"))
    named = pairs.hint("merge").join(side("left"), "left").hint("merge").join(side("right"), "right")
    one, two = F.least("left_class", "right_class"), F.greatest("left_class", "right_class")
    return named.select(one["id"].alias("left_id"), two["id"].alias("right_id"), one["n"].alias("left_n"), two["n"].alias("right_n"), "distance")


def neighbours(rows: DataFrame, key: str, radius: int, mark: str = "mark", spare: int = SPARE, scratch: Scratch | None = None) -> DataFrame:
    """key, class_id, n_same, n_links, nearest for each row: its class of equal signatures, and other classes within *radius*.

    ``nearest`` is the least distance to another class, null without one.
    Rows without a signature are classes of their own without links.
    """
    scratch = scratch or Scratch(rows.sparkSession)
    known = scratch.stored(classes(rows.where(F.col(mark).isNotNull()), key, mark), "mark-classes")
    pairs = near_pairs(known, radius, "mark", spare)
    ends = pairs.select(F.explode(F.array("left", "right")).alias("mark"), "distance")
    linked = ends.groupBy("mark").agg(F.count("*").alias("n_links"), F.min("distance").alias("nearest"))
    # Written first, so that Spark can split the join at a signature with many rows.
    of = scratch.stored(known.hint("merge").join(linked, "mark", "left"), "mark-links")
    found = rows.select(F.col(key), F.col(mark).alias("mark")).hint("merge").join(of, "mark", "left")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return found.select(key, F.coalesce("class_id", F.col(key)).alias("class_id"), F.coalesce("n", one).alias("n_same"), F.coalesce("n_links", none).alias("n_links"), "nearest")


def leader_groups(rows: DataFrame, by: list[str], key: str, most: int, mark: str = "mark", scratch: Scratch | None = None) -> DataFrame:
    """Adds leader: within each group of equal *by* columns, the first leader closer than *most* bits.

    Members are taken in the order of their key: one that is near no earlier
    leader is a leader itself, every other belongs to the first it is near to.
    That order decides alone, however rows are dealt. A round takes the first
    members left of each group, finds the leaders among them, and compares
    all that are left with these; what is near none goes to the next round. So a
    round drops at least the members it tried, and a task meets no group
    whole: groups are joined with a bounded list of leaders. A row without a
    signature leads itself; nulls in *by* are a group like any other.
    """
    if not by or most < 1:
        raise ValueError("groups need a column, and a leader must be near itself")
    scratch = scratch or Scratch(rows.sparkSession)
    columns = rows.columns
    rows = scratch.stored(rows, "signed")  # signatures are made once, not by every reader of the rows
    usable = F.col(key).isNotNull() & F.col(mark).isNotNull()
    whole = rows.where(~usable).select(*columns, F.col(key).alias("leader"))
    left, tried = rows.where(usable), FIRST_LEADERS
    member = F.struct(F.col(key).alias("id"), F.col(mark).alias("mark"))
    near = lambda leaders, of: F.filter(leaders, lambda x: hamming(x["mark"], of) < most)
    led_by = lambda so_far, x: F.when(F.size(near(so_far, x["mark"])) > 0, so_far).otherwise(F.concat(so_far, F.array(x)))
    while not left.isEmpty():
        nth = F.row_number().over(W.partitionBy(*by).orderBy(key))
        first = left.select(*by, key, mark).withColumn("_nth", nth).where(F.col("_nth") <= tried)
        listed = first.groupBy(*by).agg(F.array_sort(F.collect_list(member)).alias("_tried"))  # *tried* members at most
        leaders = F.aggregate("_tried", F.slice("_tried", 1, 0), led_by).alias("_leaders")
        led = scratch.stored(listed.select(*(F.col(c).alias(f"_{c}") for c in by), leaders), "leaders")
        same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by))
        compared = left.join(led, same).select(*columns, F.get(near(F.col("_leaders"), F.col(mark)), 0)["id"].alias("leader"))
        compared = scratch.stored(compared, "compared")
        whole = whole.unionByName(compared.where("leader is not null"))
        left, tried = compared.where("leader is null").select(*columns), min(tried * 2, MOST_LEADERS)
    return whole
