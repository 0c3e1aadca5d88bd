"""Row visibility, paging, request-rate audit and activity sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.session import small_side, written


def visible_rows(df: DataFrame, principals: DataFrame, owner: str) -> DataFrame:
    """Rows each principal may see: administrators all, others their own.

    ``principals``: principal, is_admin. Two equi-joins instead of an ``or`` condition; the
    list of principals is broadcast when small, so a hot owner is never shuffled.
    """
    people = principals.filter(~F.col("is_admin")).select(F.col("principal"), F.col("principal").alias(owner))
    own = df.join(small_side(people), owner)
    admins = principals.filter("is_admin").select(F.collect_list("principal").alias("admins"))
    every = df.select(*df.columns, F.explode(admins.scalar()).alias("principal"))
    return own.select(*df.columns, "principal").unionByName(every)


VISIBLE_PART = 1 << 15  # rows to a bitmap, as the engine's bitmaps hold


def numbered_rows(df: DataFrame, key: str) -> DataFrame:
    """(``key``, row_no): a number for each row in the order of a unique ``key``, from counts of range parts."""
    laid = written(df.select(key).repartitionByRange(key).sortWithinPartitions(key).withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = laid.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # a row for each part
    offsets = parts.select("part", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return laid.withColumn("part", part).join(small_side(offsets), "part").select(key, (F.col("ahead") + place).alias("row_no"))


def visible_sets(df: DataFrame, principals: DataFrame, owner: str, key: str) -> tuple[DataFrame, DataFrame]:
    """(principal, part, rows, n_rows) bitmaps of what each principal may see, and the row numbers they are over.

    Rows of ``df`` are numbered by ``key``; a bitmap holds the rows of one part of 2^15 numbers. An administrator is one row without part
    and bitmap, the mark for all rows, so the size does not depend on how many administrators there are. Bits are combined map-side: an owner
    of any number of rows sends a bitmap per part and task.
    """
    numbers = written(numbered_rows(df, key))
    owned = df.select(key, owner).join(numbers, key).select(F.col(owner).alias("principal"), F.expr(f"row_no div {VISIBLE_PART}").alias("part"), (F.col("row_no") % VISIBLE_PART).alias("bit"))
    people = principals.filter(~F.col("is_admin")).select("principal")
    mine = owned.join(small_side(people), "principal", "left_semi").groupBy("principal", "part").agg(F.bitmap_construct_agg("bit").alias("rows"))
    sets = mine.select("principal", "part", "rows", F.bitmap_count("rows").alias("n_rows"))
    total = numbers.agg(F.count(F.lit(1))).scalar()
    every = principals.filter("is_admin").select("principal", F.lit(None).cast("long").alias("part"), F.lit(None).cast("binary").alias("rows"), total.alias("n_rows"))
    return sets.unionByName(every), numbers


def rows_of(df: DataFrame, sets: DataFrame, numbers: DataFrame, key: str, principal: str) -> DataFrame:
    """The rows of ``df`` that one principal's sets let through."""
    own = sets.where(F.col("principal") == principal)
    bits = own.where("part is not null").select("part", "rows")
    placed = numbers.withColumn("part", F.expr(f"row_no div {VISIBLE_PART}")).withColumn("bit", F.expr(f"cast(row_no % {VISIBLE_PART} as int)"))
    held = placed.join(small_side(bits), "part").where(F.expr("(conv(hex(substring(rows, cast(bit div 8 as int) + 1, 1)), 16, 10) >> (bit % 8)) & 1 = 1")).select(key)
    if own.where("part is null").isEmpty():
        return df.join(held, key, "left_semi")
    return df


def page_directory(df: DataFrame, *order: str, size: int = fv.PAGE_SIZE) -> tuple[DataFrame, DataFrame]:
    """(page, first: struct of the order's columns) for every page, and the rows laid out in range parts (written).

    One sort by range parts and a count for each part tell where every page starts; no row is numbered through the whole table.
    """
    at = F.monotonically_increasing_id()
    laid = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    parts = laid.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    ahead = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = small_side(parts.select("_part", F.coalesce(ahead, F.lit(0)).alias("ahead")))
    numbered = laid.withColumn("_part", part).join(offsets, "_part").withColumn("_no", F.col("ahead") + place)
    starts = numbered.where(F.col("_no") % size == 0)
    keys = [F.col(o).alias(o) for o in order]
    return starts.select((F.expr(f"_no div {size}") + 1).alias("page"), F.struct(*keys).alias("first")), laid.drop("_at")


def directory_page(laid: DataFrame, directory: DataFrame, number: int, *order: str, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` by its start key: a range filter that reaches the scan, so only the files that hold the page are read."""
    found = directory.where(F.col("page").isin(number, number + 1)).orderBy("page").collect()
    if not found or found[0].page != number:
        return laid.limit(0)
    kinds = dict(laid.dtypes)
    bound = lambda at, o: F.lit(at[o]).cast(kinds[o])
    whole = lambda at: F.struct(*[bound(at, o).alias(o) for o in order])
    own = F.struct(*[F.col(o) for o in order])
    low = found[0].first
    # the first column's bound is what files are skipped by
    rows = laid.where(F.col(order[0]) >= bound(low, order[0])).where(own >= whole(low))
    if len(found) > 1:
        high = found[1].first
        rows = rows.where(F.col(order[0]) <= bound(high, order[0])).where(own < whole(high))
    return rows.orderBy(*order).limit(size)


def visible_to(df: DataFrame, owner: str, principal: str, is_admin: bool) -> DataFrame:
    """The same for one principal: a filter that reaches the scan."""
    return df if is_admin else df.filter(F.col(owner) == principal)


def page(df: DataFrame, number: int, *order: Column | str, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) under a total order."""
    return df.orderBy(*order).offset(size * (number - 1)).limit(size)


def page_after(df: DataFrame, key: str, last_seen, size: int = fv.PAGE_SIZE) -> DataFrame:
    """Deep paging: the page behind ``last_seen``; the bound reaches the scan."""
    return df.filter(F.col(key) > last_seen).orderBy(key).limit(size)


def limits_table(spark, limits: dict[str, tuple[int, int]] | None = None) -> DataFrame:
    rows = [(scope, n, s) for scope, (n, s) in (limits or fv.RATE_LIMITS).items()]
    return spark.createDataFrame(rows, "scope string, max_requests int, seconds int")


def rate_audit(requests: DataFrame, limits: DataFrame, keep_all: bool = False) -> DataFrame:
    """Requests that exceed their scope's limit within its trailing window.

    ``requests``: request_id, user, scope, us (microseconds). A user's log is split into
    time slices of sixty windows, and each slice also gets the requests of the window
    before it, so one busy user spreads over many tasks and counts stay exact.
    """
    sized = requests.join(F.broadcast(limits), "scope").withColumn("span", F.col("seconds").cast("long") * 1_000_000)
    own = F.floor(F.col("us") / (F.col("span") * 60)).cast("long")
    reach = F.floor((F.col("us") + F.col("span")) / (F.col("span") * 60)).cast("long")
    placed = sized.withColumn("home", own).withColumn("slice", F.explode(F.sequence(own, reach)))
    counted = placed.select(
        "request_id", "user", "scope", "us", "max_requests", "span", "home", "slice",
    )
    # range frames take literal bounds, so each distinct span gets its own window
    spans = [r["seconds"] for r in limits.select("seconds").distinct().collect()]
    n = F.lit(None).cast("long")
    for seconds in sorted(spans):
        frame = Window.partitionBy("user", "scope", "slice").orderBy("us").rangeBetween(-seconds * 1_000_000, 0)
        n = F.coalesce(n, F.when(F.col("span") == seconds * 1_000_000, F.count(F.lit(1)).over(frame)))
    out = counted.withColumn("n_in_window", n).filter(F.col("slice") == F.col("home"))
    if not keep_all:
        out = out.filter(F.col("n_in_window") > F.col("max_requests"))
    return out.select("request_id", "user", "scope", "us", "n_in_window", "max_requests")


def activity_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Sessions of events (user, us) parted by gaps of more than ``gap_seconds``.

    Events are first folded into one row per user and minute, which cannot hold a gap, so
    a busy user contributes minutes and not events to the session window.
    """
    minute = events.groupBy("user", F.floor(F.col("us") / 60_000_000).alias("m")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi"), F.count(F.lit(1)).alias("n")
    )
    w = Window.partitionBy("user").orderBy("m")
    starts = F.coalesce((F.col("lo") - F.lag("hi").over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    numbered = minute.withColumn("new", starts).withColumn("session_no", F.sum("new").over(w))
    return numbered.groupBy("user", "session_no").agg(
        F.min("lo").alias("start_us"), F.max("hi").alias("end_us"), F.sum("n").alias("n_events")
    )
