"""Two overlapping pulls of the same report become one set of legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from slipstream import config
from slipstream.functions.numbers import total
from slipstream.schema import IDENTITY, LEG_COLUMNS
from slipstream.session import cut_lineage

SETTLEMENT = ["ggr", "net_revenue"]


def occurrence_key(legs: DataFrame, chunk_rows: int = config.OCCURRENCE_CHUNK_ROWS) -> DataFrame:
    """Add ``occurrence``: 0 for the first copy of a bet in its file, then 1, 2, ...

    Copies are numbered inside stretches of at most ``chunk_rows`` file rows, so
    no task sorts more than that even if one bet fills a third of the file. The
    copies in earlier stretches are then added; only bets that span stretches
    have any.
    """
    # As one struct the nulls of a bet's columns are equal in a plain join, which
    # then reuses the window's partitioning instead of moving the legs again. The
    # struct stands for its columns, so that they are not shuffled twice.
    bet = ["source", *IDENTITY]
    parts = legs.select(
        F.struct(*bet).alias("__bet"),
        F.floor(F.col("source_row") / F.lit(chunk_rows)).alias("__stretch"),
        *[c for c in legs.columns if c not in bet],
    )
    in_stretch = Window.partitionBy("__bet", "__stretch").orderBy("source_row")
    # Bets in several stretches are few. A bet alone with its hash is in one stretch if the hash is; of the
    # others the copies are counted by the bet itself, so a false match of hashes changes nothing.
    hashed = parts.withColumn("__hash", F.xxhash64("__bet"))
    # They are written, so that a plan made later knows how few they are.
    spanning = cut_lineage(
        hashed.groupBy("__hash")
        .agg(F.min("__stretch").alias("__first"), F.max("__stretch").alias("__last"))
        .where(F.col("__first") < F.col("__last"))
        .select("__hash")
    )
    earlier = (
        Window.partitionBy("__bet").orderBy("__stretch").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = (
        hashed.join(spanning, "__hash", "left_semi")
        .groupBy("__bet", "__stretch")
        .agg(F.count("*").alias("__copies"))
        .withColumn("__offset", F.sum("__copies").over(earlier))
        .where(F.col("__offset") > 0)
        .select("__bet", "__stretch", "__offset")
    )
    numbered = parts.withColumn("__nth", F.row_number().over(in_stretch) - 1)
    return numbered.join(offsets, ["__bet", "__stretch"], "left").select(
        *[F.col("__bet")[c].alias(c) if c in bet else F.col(c) for c in legs.columns],
        (F.col("__nth") + F.coalesce(F.col("__offset"), F.lit(0))).cast("long").alias("occurrence"),
    )


def file_stats(legs: DataFrame) -> DataFrame:
    """Per file: rows, native-currency sums and the span of betslip times."""
    return legs.groupBy("source").agg(
        F.count("*").alias("rows"),
        total("stake").alias("stake"),
        total("ggr").alias("ggr"),
        F.min("betslip_ts").alias("betslip_min"),
        F.max("betslip_ts").alias("betslip_max"),
    )


def pair_pulls(a: DataFrame, b: DataFrame) -> DataFrame:
    """Match the n-th copy of each bet in one pull with the n-th in the other.

    One full outer join serves overlap, conflicts, the settlement update and the
    union. Bet plus occurrence is unique per file, so its keys cannot be hot.
    Nulls match nulls. Columns of the pulls come out as ``a_*`` and ``b_*``.
    """
    keys = [*IDENTITY, "occurrence"]

    def side(df: DataFrame, tag: str) -> DataFrame:
        named = occurrence_key(df)
        return named.select(
            *[F.col(c).alias(f"{tag}_{c}") for c in named.columns], F.lit(True).alias(f"in_{tag}")
        )

    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}"))
    pairs = side(a, "a").join(side(b, "b"), on, "full_outer")
    return pairs.withColumns(
        {f"in_{t}": F.coalesce(F.col(f"in_{t}"), F.lit(False)) for t in ("a", "b")}
    )


def _shared() -> Column:
    return F.col("in_a") & F.col("in_b")


def overlap_rows(pairs: DataFrame) -> DataFrame:
    """Rows of the first pull that the second holds too."""
    return pairs.where(_shared())


def settlement_conflicts(pairs: DataFrame) -> DataFrame:
    """One row: shared bets whose settlement moved, with GGR before and after."""
    same = F.lit(True)
    for c in SETTLEMENT:
        same = same & F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))
    return pairs.where(_shared() & ~same).agg(
        F.count("*").alias("conflicts"),
        total("a_ggr").alias("ggr_before"),
        total("b_ggr").alias("ggr_after"),
    )


def reconciled_union(pairs: DataFrame) -> DataFrame:
    """All bets, each at its larger multiplicity; the later pull settles them."""

    def pick(c: str) -> Column:
        first, second = ("b", "a") if c in SETTLEMENT else ("a", "b")
        return F.when(F.col(f"in_{first}"), F.col(f"{first}_{c}")).otherwise(F.col(f"{second}_{c}"))

    columns = [*LEG_COLUMNS, "source", "source_row"]
    return row_identity(pairs.select(*[pick(c).alias(c) for c in columns]))


def later_wins(pairs: DataFrame) -> DataFrame:
    """The first pull's rows, settled as the later pull has them."""
    return reconciled_union(pairs.where("in_a"))


def row_identity(legs: DataFrame) -> DataFrame:
    """Add ``row_id``: file order first, then row order in the file.

    It comes from the data alone, so a task that runs again makes the same ids.
    """
    place = F.lit(None).cast("long")
    for i, name in enumerate(config.PULLS):
        place = F.when(F.col("source") == name, F.lit(i).cast("long")).otherwise(place)
    known = F.coalesce(
        place, F.raise_error(F.concat(F.lit("unknown source: "), F.col("source"))).cast("long")
    )
    return legs.withColumn("row_id", F.shiftleft(known, 56) + F.col("source_row"))


def fingerprints() -> list[Column]:
    """Two 64-bit hashes of everything that makes two legs exact copies; copies have equal ones."""
    columns = [*LEG_COLUMNS, "stake_eur"]
    return [F.xxhash64(*columns), F.xxhash64(F.lit(1), *columns)]


def shared_fingerprints(legs: DataFrame) -> DataFrame:
    """``print_1``, ``print_2`` of which there are several legs: what is shuffled is 16 bytes and a count."""
    prints = legs.select(*[c.alias(f"print_{i}") for i, c in enumerate(fingerprints(), 1)])
    several = prints.groupBy("print_1", "print_2").agg(F.count("*").alias("n")).where("n > 1")
    return several.select("print_1", "print_2")


def exact_duplicates(legs: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """One row: legs equal in every export column, counting all their copies.

    Legs whose fingerprint several share are candidates; only they are compared by their columns,
    so a false match of fingerprints changes nothing.
    """
    shared = cut_lineage(shared_fingerprints(legs)) if shared is None else shared
    printed = legs.withColumns({f"print_{i}": c for i, c in enumerate(fingerprints(), 1)})
    candidates = printed.join(shared.select("print_1", "print_2"), ["print_1", "print_2"], "left_semi")
    copies = (
        candidates.groupBy(*LEG_COLUMNS, "stake_eur").agg(F.count("*").alias("copies")).where("copies > 1")
    )

    def rows_of(bet_type: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("bet_type") == bet_type, F.col("copies"))), F.lit(0))

    staked = (F.col("stake_eur") * F.col("copies")).cast("decimal(28,6)")
    return copies.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("dup_rows"),
        rows_of("SIMPLE").alias("dup_rows_simple"),
        rows_of("COMBINED").alias("dup_rows_combined"),
        F.coalesce(F.sum(staked), F.lit(0)).alias("dup_stake_eur"),
    )
