"""Document fingerprints: invertible Bloom look-up sketches of paragraphs.

A text's paragraphs (runs up to a line break or sentence end, long ones cut) are hashed to
32-bit digests; each digest goes to one cell in each of three sub-tables, as a count and as the
XOR of the digest with its check. Sketches of two texts subtract cell by cell, so what they
share vanishes; peeling (a cell of one digest gives it away, and it leaves its other cells)
recovers the digests that differ. Where cells remain, a larger sketch is tried. All of it is
explode and group-by over rows dealt once by document: no cell of a document leaves its task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, n_partitions, ranked_in_ranges, text_or_empty

#: Cells of each sub-table in a fingerprint.
CELLS = 8
#: Peeling rounds; each takes one sub-table. At the load of the larger sketches far fewer suffice.
ROUNDS = 15
#: Rounds for the fingerprints themselves, which are small; a pair that needs more is tried again at a larger size.
FIRST_ROUNDS = 9
PARAGRAPH = r"[^\n.!?]{0,120}[\n.!?]+|[^\n.!?]{1,120}"


def paragraph_digests(text: Column, pattern: str = PARAGRAPH) -> Column:
    """Distinct 32-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.hash(p)))


def _packed(digest: Column) -> Column:
    """The digest above, its check below."""
    return F.shiftleft(digest.cast("long"), 32).bitwiseOR(F.xxhash64(digest.cast("int")).bitwiseAND(0xFFFFFFFF))


def _digest(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def _cell(digest: Column, sub: int, size: Column, seed: Column) -> Column:
    return (F.pmod(F.xxhash64(digest, seed + sub), size) * 3 + sub).cast("int")


def _placed(rows: DataFrame, keys: list[str], named: Column) -> DataFrame:
    """A row for each cell that each digest goes to; ``named`` is an array of structs with ``digests`` (an array), whose other fields stay."""
    each = rows.select(*keys, "size", "seed", F.explode(named).alias("t")).select(*keys, "size", "seed", "t", F.explode("t.digests").alias("digest")).select("*", "t.*").drop("t", "digests")
    return each.withColumns({"x": _packed(F.col("digest")), "at": F.array(*[_cell(F.col("digest"), j, F.col("size"), F.col("seed")) for j in range(3)])}).withColumn("cell", F.explode("at")).drop("at", "digest")


def sketches(rows: DataFrame, keys: list[str], columns: tuple[str, ...]) -> DataFrame:
    """Sketch cells of the digests in each of ``columns``: ``keys``, ``which`` (the column), ``size``, ``seed``, ``cell``, ``n``, ``x``.

    ``rows`` has ``keys`` (unique), ``size`` (cells of a sub-table) and ``seed``; it should be dealt by a prefix of ``keys``.
    """
    named = F.array(*[F.struct(F.lit(c).alias("which"), F.col(c).alias("digests")) for c in columns])
    return _placed(rows, keys, named).groupBy(*keys, "which", "size", "seed", "cell").agg(F.count(F.lit(1)).cast("int").alias("n"), F.bit_xor("x").alias("x"))


def subtracted(cells: DataFrame, keys: list[str], pairs: dict[str, tuple[str, str]]) -> DataFrame:
    """For each ``kind`` of ``pairs``, the sketch of its first text minus that of its second, cell by cell; what cancels is gone."""
    which = F.col("which")
    side = lambda kind, sign: F.struct(F.lit(kind).alias("kind"), F.lit(sign).alias("sign"))
    sides = F.array_compact(F.array(*[F.when(which == plus, side(kind, 1)).when(which == minus, side(kind, -1)) for kind, (plus, minus) in pairs.items()]))
    each = cells.select(*keys, "size", "seed", "cell", "n", "x", F.explode(sides).alias("s"))
    return each.groupBy(*keys, F.col("s.kind").alias("kind"), "size", "seed", "cell").agg(F.sum(F.col("n") * F.col("s.sign")).cast("int").alias("n"), F.bit_xor("x").alias("x")).where("n <> 0 or x <> 0")


def peel(cells: DataFrame, keys: list[str], rounds: int = ROUNDS, keep_digests: bool = False) -> DataFrame:
    """Peels subtracted sketches: ``keys``, ``size``, ``seed``, ``cell``, ``n``, ``x``.

    Returns ``keys``, ``n_left`` (cells that remain: 0 means success) and ``n_found`` (digests
    recovered); pairs of equal sketches give no row. With ``keep_digests`` also ``only_plus`` and
    ``only_minus``, the recovered digests.
    """
    found = (lambda x: F.struct(F.lit(-1).alias("cell"), F.col("n").alias("n"), F.lit(0).cast("long").alias("x"), x.alias("got"))) if keep_digests else (lambda x: F.struct(F.lit(-1).alias("cell"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("x"), F.lit(0).alias("got")))
    cells = cells.withColumn("got", F.lit(0))
    for r in range(rounds):
        j = r % 3
        digest = _digest(F.col("x"))
        pure = (F.col("cell") % 3 == j) & (F.abs("n") == 1) & (_packed(digest) == F.col("x")) & (_cell(digest, j, F.col("size"), F.col("seed")) == F.col("cell"))
        leave = [F.struct(_cell(digest, o, F.col("size"), F.col("seed")).alias("cell"), (-F.col("n")).alias("n"), F.col("x").alias("x"), F.lit(0).alias("got")) for o in range(3) if o != j]
        stay = F.struct("cell", "n", "x", "got")
        moved = cells.select(*keys, "size", "seed", F.explode(F.when(pure & (F.col("cell") >= 0), F.array(*leave, found(digest))).otherwise(F.array(stay))).alias("e"))
        cells = moved.groupBy(*keys, "size", "seed", F.col("e.cell").alias("cell"), F.col("e.got").alias("got")).agg(F.sum("e.n").cast("int").alias("n"), F.bit_xor("e.x").alias("x")).where("cell < 0 or n <> 0 or x <> 0")
    out = [F.count(F.when(F.col("cell") >= 0, 1)).alias("n_left"), F.coalesce(F.sum(F.when(F.col("cell") < 0, F.lit(1) if keep_digests else F.col("n"))), F.lit(0)).alias("n_found")]
    if keep_digests:
        side = lambda s: F.sort_array(F.collect_list(F.when((F.col("cell") < 0) & (F.col("n") == s), F.col("got"))))
        out += [side(1).alias("only_plus"), side(-1).alias("only_minus")]
    return cells.groupBy(*keys).agg(*out)


def _peeled(pairs: DataFrame, keys: list[str], attempt: int, **options) -> DataFrame:
    """Sketches ``plus`` and ``minus`` of each row at the size of ``attempt``, subtracts (in the same sum over each cell) and peels."""
    sized = pairs.withColumns(_attempt(attempt, F.size("plus") + F.size("minus")))
    sides = F.array(*[F.struct(F.lit(sign).alias("sign"), F.col(c).alias("digests")) for sign, c in ((1, "plus"), (-1, "minus"))])
    cells = _placed(sized, keys, sides).groupBy(*keys, "size", "seed", "cell").agg(F.sum("sign").cast("int").alias("n"), F.bit_xor("x").alias("x"))
    return peel(cells.where("n <> 0 or x <> 0"), keys, **options)


def differing_digests(pairs: DataFrame, keys: list[str], tries: int = 4) -> DataFrame:
    """The digests that ``plus`` and ``minus`` of each row do not share, by sketches.

    Returns ``keys``, ``only_plus``, ``only_minus`` (sorted), ``attempt`` (0: the fingerprint's own
    size sufficed; each further one takes a larger sketch and another seed). A pair that fails every
    attempt, which random digests do not, is told apart by its digest sets.
    """
    n = n_partitions(pairs.sparkSession)
    left, done = pairs.select(*keys, "plus", "minus"), None
    for attempt in range(tries):
        peeled = _peeled(left.repartition(n, *keys), keys, attempt, keep_digests=True)
        got = checkpointed(left.join(peeled, keys, "left").withColumn("attempt", F.lit(attempt)))
        ok = got.where(F.coalesce("n_left", F.lit(0)) == 0).select(*keys, *[F.coalesce(c, F.array().cast("array<int>")).alias(c) for c in ("only_plus", "only_minus")], "attempt")
        done = ok if done is None else done.unionByName(ok)
        left = got.where("n_left > 0").select(*keys, "plus", "minus")
        if left.isEmpty():
            return done
    rest = left.select(*keys, F.sort_array(F.array_except("plus", "minus")).alias("only_plus"), F.sort_array(F.array_except("minus", "plus")).alias("only_minus"), F.lit(tries).alias("attempt"))
    return done.unionByName(rest)


def _attempt(k: int, both: Column) -> dict[str, Column]:
    """Size and seed of the ``k``-th attempt, for texts of ``both`` digests together."""
    size = F.lit(CELLS) if k == 0 else (F.ceil(both * 0.7 * 2 ** (k - 1)) + 8)
    return {"size": size.cast("int"), "seed": F.lit(11 * k)}


def previous_documents(sizes: DataFrame) -> DataFrame:
    """``key``, ``n`` -> ``key``, ``prev_key``, ``prev_n``: the key before, in a ring (before the first: the last)."""
    ranked = ranked_in_ranges(sizes, "key")
    inside = Window.partitionBy("part").orderBy("at")
    tails = ranked.groupBy("part").agg(F.max(F.struct("key", "n")).alias("tail"))
    order = Window.orderBy("part")  # a row for each partition
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = tails.select("part", F.coalesce(F.lag("tail").over(order), F.last("tail").over(everything)).alias("before"))
    prev = F.coalesce(F.lag(F.struct("key", "n")).over(inside), F.col("before"))
    return ranked.join(F.broadcast(before), "part").select("key", prev.alias("p")).select("key", F.col("p.key").alias("prev_key"), F.col("p.n").alias("prev_n"))


def fingerprint_string(which: str, of: str) -> Column:
    """The number of paragraphs and the sketch's cells, from rows of one text."""
    cells = F.array_join(F.transform(F.sort_array(F.col(which)), lambda c: F.concat_ws(":", c.cell.cast("string"), c.n.cast("string"), F.lower(F.hex(c.x)))), ";")
    return F.concat_ws("|", F.size(of).cast("string"), F.coalesce(cells, F.lit("")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of an edited version of it.

    The edited version has the last quarter of the code points replaced by the first as many (or
    all) of the next document's, in ascending id (after the last: the first). Returns ``id_col``,
    ``n_chars``, ``edited_sha256``, ``fingerprint``, ``edited_fingerprint``, ``near_edited``,
    ``near_next``: the share of paragraphs in common (of all paragraphs of both), from the number
    of digests that peeling the difference of the two fingerprints recovers; where they differ by more
    than a fingerprint can tell, larger sketches of the two texts are subtracted. Two texts without paragraphs are alike (1).

    A null text is empty. A null id comes first in the order. Of rows that repeat an id, one of
    least text hash is what the document before sees as next; each gets its own result. A lone
    document is its own next; an empty table gives no rows. Other columns are ignored.
    """
    n_parts = n_partitions(docs.sparkSession)
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    given = docs.select(key.alias("key"), text_or_empty(text_col).alias("text"))
    before = previous_documents(given.groupBy("key").agg(F.max(F.char_length("text")).alias("n")))
    # One shuffle of the texts serves both sides: rows by id, and what the document before needs.
    dealt = given.repartition(n_parts, "key").withColumn("rn", F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("text"))))
    heads = dealt.where(F.negative("rn") == -1).join(before, "key").select(
        F.col("prev_key").alias("key"), F.substring(F.col("text"), F.lit(1), F.floor(F.col("prev_n") / 4).cast("int")).alias("head"), paragraph_digests(F.col("text")).alias("next")
    )
    n = F.char_length("text")
    cut = F.floor(n / 4).cast("int")
    both = dealt.join(heads, "key").withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("head"), F.lit(1), cut)))
    rows = checkpointed(
        both.select(
            F.struct("key", "rn").alias("u"),
            n.cast("long").alias("n_chars"),
            F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
            paragraph_digests(F.col("text")).alias("own"),
            paragraph_digests(F.col("edited_text")).alias("edited"),
            "next",
        )
    )
    dealt_rows = rows.repartition(n_parts, "u")

    # The published fingerprints: sketches of one size and seed, so that any two can be subtracted.
    cells = sketches(dealt_rows.withColumns(_attempt(0, F.lit(0))), ["u"], ("own", "edited", "next"))
    item = F.struct("cell", "n", "x")
    strings = cells.groupBy("u").agg(*[F.collect_list(F.when(F.col("which") == w, item)).alias(f"_{w}") for w in ("own", "edited")])

    kinds = {"near_edited": "edited", "near_next": "next"}
    tried = checkpointed(peel(subtracted(cells, ["u"], {kind: ("own", other) for kind, other in kinds.items()}), ["u", "kind"], FIRST_ROUNDS).withColumn("attempt", F.lit(0)))
    # Where cells remain, larger sketches are subtracted: one sized for the pair, then twice and four times as large.
    failed = tried.where("n_left > 0").select("u", "kind")
    for attempt in (1, 2, 3):
        if failed.isEmpty():
            break
        other = F.coalesce(*[F.when(F.col("kind") == kind, F.col(c)) for kind, c in kinds.items()])
        again = rows.join(failed, "u").select("u", "kind", F.col("own").alias("plus"), other.alias("minus")).repartition(n_parts, "u")
        got = checkpointed(_peeled(again, ["u", "kind"], attempt).withColumn("attempt", F.lit(attempt)))
        tried, failed = tried.unionByName(got), got.where("n_left > 0").select("u", "kind")
    found = tried.groupBy("u").agg(*[F.min(F.when((F.col("kind") == kind) & (F.col("n_left") == 0), F.struct("attempt", "n_found"))).alias(f"_{kind}") for kind in kinds], *[F.count(F.when(F.col("kind") == kind, 1)).alias(f"_n_{kind}") for kind in kinds])

    def likeness(kind: str, other: str) -> Column:
        together = F.size("own") + F.size(other)
        # No row: the sketches are equal. Rows but no success: the digest sets themselves.
        differ = F.when(F.coalesce(F.col(f"_n_{kind}"), F.lit(0)) == 0, F.lit(0)).otherwise(F.coalesce(F.col(f"_{kind}.n_found"), together - 2 * F.size(F.array_intersect("own", other))))
        return F.when(together == 0, F.lit(1.0)).otherwise((together - differ) / (together + differ))

    whole = dealt_rows.join(strings, "u", "left").join(found, "u", "left")
    return whole.select(
        F.when(F.col("u.key") != -(2**63), F.col("u.key")).alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint_string("_own", "own").alias("fingerprint"),
        fingerprint_string("_edited", "edited").alias("edited_fingerprint"),
        *[likeness(kind, other).alias(kind) for kind, other in kinds.items()],
    )
