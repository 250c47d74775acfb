"""Pieces of the same street name merged into the longest lines that run on without a branch.

Every piece is passed in one of two ways, as it is or turned; a way has at most one way before
it. Pointer jumping carries, with the way that lies 1, 2, 4... ways before, the number of vertices
passed, so that every piece learns its line's first way and its own place in about as many rounds
as the longest line has binary digits, and no line has to meet in one task for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.operators.network import written


def _way(piece, turned):
    return F.struct(piece.alias("piece"), turned.alias("turned"))


def _before(pieces: DataFrame) -> DataFrame:
    """(way, prev, hop, least): the way that comes before each, where two ends of one name meet alone; hop counts that one's vertices but one, least is its piece."""
    end = lambda i, far: F.struct(F.element_at("xs", i).alias("x"), F.element_at("ys", i).alias("y"), F.lit(far).alias("far"), F.col("piece_id").alias("piece"), (F.size("xs") - 1).cast("long").alias("hop"))
    ends = pieces.select("name", F.explode(F.array(end(1, False), end(-1, True))).alias("e")).select("name", "e.x", "e.y", F.struct("e.piece", "e.far", "e.hop").alias("end"))
    met = ends.groupBy("name", "x", "y").agg(F.count("*").alias("n"), F.min("end").alias("a"), F.max("end").alias("b")).where("n = 2 and a.piece <> b.piece")
    # A way that begins at one of two ends comes after the one that finishes at the other.
    step = lambda a, b: F.struct(_way(F.col(f"{a}.piece"), F.col(f"{a}.far")).alias("way"), _way(F.col(f"{b}.piece"), ~F.col(f"{b}.far")).alias("prev"), F.col(f"{b}.hop").alias("hop"), F.col(f"{b}.piece").alias("least"))
    return met.select(F.explode(F.array(step("a", "b"), step("b", "a"))).alias("s")).select("s.*")


def _jumped(before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(way, prev, hop, least) of ways whose line has a first way, that one in ``prev``; and those of rings, ``least`` being their smallest piece."""
    # What a way's last known one before it is: a first way has no row of its own.
    firsts = before.select(F.col("way").alias("prev"), F.lit(True).alias("_known"))
    table, reach = written(before.join(firsts, "prev", "left").select("way", "prev", "hop", "least", F.col("_known").isNull().alias("done"))), 1
    last = None
    while True:
        # A round that brings no way to its first one leaves rings alone; a jump wider than all that is left has passed its ring whole.
        left = table.where("not done").count()
        if not left or left == last and reach > left:
            break
        last = left
        onward = table.select(F.col("way").alias("prev"), F.col("prev").alias("_prev"), F.col("hop").alias("_hop"), F.col("least").alias("_least"), F.col("done").alias("_done"))
        moved = table.where("not done").join(onward, "prev").select("way", F.col("_prev").alias("prev"), (F.col("hop") + F.col("_hop")).alias("hop"), F.least("least", "_least").alias("least"), F.col("_done").alias("done"))
        table, reach = written(table.where("done").unionByName(moved)), 2 * reach
    return table.where("done").drop("done"), table.where("not done").drop("done")


def placed_pieces(pieces: DataFrame) -> DataFrame:
    """``pieces`` with their line's first way (``first``: piece, turned), whether they are ``turned`` in it, and ``offset``, the number of vertices before them.

    A line begins at the free end of the smaller of its two end pieces; a ring at its smallest piece, as that is.
    """
    before = written(_before(pieces))
    lines, rings = _jumped(before)
    starts = rings.select(F.col("least").alias("piece")).distinct()
    cut = before.join(rings.select("way"), "way", "left_semi").join(starts, F.col("way.piece") == F.col("piece"), "left_anti")
    round_, _ = _jumped(cut)
    after = lines.unionByName(round_).select(F.col("way.piece").alias("piece_id"), F.struct(F.col("prev").alias("first"), F.col("way.turned").alias("turned"), F.col("hop").alias("offset")).alias("w"))
    own = pieces.select("piece_id", F.explode(F.array(F.lit(False), F.lit(True))).alias("t")).select("piece_id", F.struct(_way(F.col("piece_id"), F.col("t")).alias("first"), F.col("t").alias("turned"), F.lit(0).cast("long").alias("offset")).alias("w"))
    # A way with another before it is no first way.
    own = own.join(after.select("piece_id", F.col("w.turned").alias("t")), (F.col("w.turned") == F.col("t")) & (own["piece_id"] == after["piece_id"]), "left_anti")
    best = after.unionByName(own).groupBy("piece_id").agg(F.min("w").alias("w"))
    return pieces.join(best.select("piece_id", "w.*"), "piece_id")


def line_vertices(pieces: DataFrame) -> DataFrame:
    """(name, first, seq, x, y): the vertices of every line in order, a row each, gathered nowhere."""
    n = placed_pieces(_named(pieces))
    way = lambda c: F.when(F.col("turned"), F.reverse(c)).otherwise(F.col(c))
    each = n.select("name", "first", "offset", F.posexplode(F.arrays_zip(way("xs").alias("x"), way("ys").alias("y"))).alias("k", "p"))
    return each.where("k > 0 or offset = 0").select("name", "first", (F.col("offset") + F.col("k")).alias("seq"), "p.x", "p.y")


def _named(pieces: DataFrame) -> DataFrame:
    return pieces.where("name is not null and size(xs) >= 2").select("piece_id", "name", "class", "xs", "ys")


def street_merge(pieces: DataFrame) -> DataFrame:
    """(name, line_id, class, pieces, xs, ys) of pieces (piece_id, name, class, xs, ys): where two ends of a name meet alone, the line runs on.

    Id and class are the smallest piece's. Pieces without a name or with fewer than two vertices
    go. A line is a row here, so its vertices meet at last; ``line_vertices`` has them one by one.
    """
    n = placed_pieces(_named(pieces))
    part = lambda c: F.when(F.col("offset") > 0, F.expr(f"slice({c}, 2, size({c}))")).otherwise(F.col(c))
    way = n.withColumns({c: F.when(F.col("turned"), F.reverse(c)).otherwise(F.col(c)) for c in ("xs", "ys")})
    sorted_ = F.array_sort(F.collect_list(F.struct("offset", part("xs").alias("xs"), part("ys").alias("ys"))))
    lines = way.groupBy("name", "first").agg(F.min(F.struct("piece_id", "class")).alias("s"), F.count("*").alias("pieces"), sorted_.alias("p"))
    return lines.select("name", F.col("s.piece_id").alias("line_id"), F.col("s.class").alias("class"), "pieces", F.flatten("p.xs").alias("xs"), F.flatten("p.ys").alias("ys"))
