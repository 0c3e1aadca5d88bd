"""Page geometry: columns, reading order, section headings, scanned pages, tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold import fixed_values as fv
from quirefold.functions.text import strip

PAGE = ["doc_id", "page_number"]
SCANNED_BELOW = 50


def _is_text(c: str = "text") -> Column:
    return (F.col("block_type") == 0) & (strip(F.col(c)) != "")


def page_columns(blocks: DataFrame) -> DataFrame:
    """One or two columns per page, from counts of narrow left and right blocks."""
    mid = F.col("page_width") / 2
    narrow = _is_text() & (F.col("x1") - F.col("x0") <= F.col("page_width") * 0.75)
    left = narrow & (F.col("x1") <= mid * 1.15)
    right = narrow & ~(F.col("x1") <= mid * 1.15) & (F.col("x0") >= mid * 0.85)
    counts = blocks.groupBy(*PAGE).agg(F.count_if(left).alias("n_left"), F.count_if(right).alias("n_right"))
    two = (F.col("n_left") >= 2) & (F.col("n_right") >= 2)
    return counts.withColumn("n_columns", F.when(two, 2).otherwise(1))


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks with column id (-1 full width, 0, 1) and reading number per page.

    Grouping and ranking share the page as key, so this is one shuffle. The section heading
    and the text length are taken before it, so a reader that needs only those does not move
    the text.
    """
    mid = F.col("page_width") / 2
    page = Window.partitionBy(*PAGE)
    body = strip(F.col("text"))
    solid = blocks.filter(_is_text()).select(
        *PAGE, "block_no", "page_width", "x0", "y0", "x1", "y1", body.alias("text"),
        heading(body).alias("heading"), F.length(body).alias("chars"),
    )
    width = F.col("x1") - F.col("x0")
    narrow = width <= F.col("page_width") * 0.75
    left = narrow & (F.col("x1") <= mid * 1.15)
    right = narrow & ~(F.col("x1") <= mid * 1.15) & (F.col("x0") >= mid * 0.85)
    counted = solid.withColumn("n_left", F.count_if(left).over(page)).withColumn("n_right", F.count_if(right).over(page))
    two = (F.col("n_left") >= 2) & (F.col("n_right") >= 2)
    col_id = (
        F.when(width > F.col("page_width") * 0.72, -1)
        .when(two & ((F.col("x0") + F.col("x1")) / 2 >= mid), 1)
        .otherwise(0)
    )
    boxes = [F.round(c, 2).alias(c) for c in ("x0", "y0", "x1", "y1")]
    placed = counted.select(*PAGE, "block_no", "text", *boxes, col_id.alias("column_id"), "heading", "chars")
    order = page.orderBy(F.col("column_id") + 1, "y0", "block_no")
    return placed.withColumn("reading_no", F.row_number().over(order) - 1)


def heading(text: Column) -> Column:
    """The first line when it reads as a section heading of fewer than 80 characters, else null."""
    line = strip(F.substring_index(text, "\n", 1))
    return F.when(line.rlike("(?U)" + fv.SECTION_HEADING) & (F.length(line) < 80), line)


def page_sections(blocks: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ordered blocks with the last heading above each on its page (in_page), and per page what it takes over.

    The second table has a row for every page with text or a table: carry_in, the section handed on to it, and ``read``, false for scanned pages
    (little text and, by ``cells``: doc_id, page_number, no table). A page hands on the section of its last block in
    reading order unless it is scanned. This runs over one row per page, not over blocks.
    """
    raw = Window.partitionBy(*PAGE).orderBy("block_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = blocks.withColumn("in_page", F.last("heading", ignorenulls=True).over(raw))
    pages = marked.groupBy(*PAGE).agg(
        F.max_by("in_page", "reading_no").alias("carry_out"), F.sum("chars").alias("chars")
    )
    read = F.coalesce(F.col("chars") >= SCANNED_BELOW, F.lit(False))
    if cells is not None:
        pages = pages.join(cells.select(*PAGE, F.lit(True).alias("has_table")).distinct(), PAGE, "full_outer")
        read = read | F.col("has_table").isNotNull()
    pages = pages.withColumn("read", read)
    before = Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)
    carry = F.last(F.when(F.col("read"), F.col("carry_out")), ignorenulls=True).over(before)
    return marked, pages.select(*PAGE, carry.alias("carry_in"), "read")


def section_carry(blocks: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Ordered blocks with the section each belongs to.

    ``blocks`` as :func:`reading_order` returns them, ``cells`` as in :func:`page_sections`. Headings take effect in raw block order.
    """
    marked, pages = page_sections(blocks, cells)
    joined = marked.join(pages.drop("read"), PAGE)
    section = F.coalesce("in_page", "carry_in", F.lit(fv.FIRST_SECTION))
    return joined.withColumn("section_title", section).drop("in_page", "carry_in", "heading", "chars")


def page_stream(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Raw page blocks and table cells (doc_id, page_number, table_no, row, col, cell) as one ordered stream of text blocks.

    Rows: doc_id, page_number, kind, no (in this order), column_id, text, section_title and box. A page's tables come first (kind 0, column -1,
    no box, the section handed on to the page), as Markdown; its text follows in reading order (kind 1). Scanned pages without a table are left out.
    """
    marked, pages = page_sections(reading_order(blocks), cells)
    box = ["x0", "y0", "x1", "y1"]
    text = marked.join(pages.where("read"), PAGE).select(
        *PAGE, F.lit(1).alias("kind"), F.col("reading_no").cast("long").alias("no"), "column_id", "text",
        F.coalesce("in_page", "carry_in", F.lit(fv.FIRST_SECTION)).alias("section_title"), *box,
    )
    tables = table_markdown(cells, *PAGE, "table_no").join(pages, PAGE).select(
        *PAGE, F.lit(0).alias("kind"), F.col("table_no").cast("long").alias("no"), F.lit(-1).alias("column_id"), F.col("markdown").alias("text"),
        F.coalesce("carry_in", F.lit(fv.FIRST_SECTION)).alias("section_title"), *[F.lit(None).cast("double").alias(c) for c in box],
    )
    return tables.unionByName(text)


def scanned_pages(blocks: DataFrame, cells: DataFrame | None = None, minimum: int = SCANNED_BELOW) -> DataFrame:
    """Pages that need character recognition: too little text and no table."""
    text = blocks.groupBy(*PAGE).agg(
        F.sum(F.when(_is_text(), F.length(strip(F.col("text")))).otherwise(0)).alias("chars")
    )
    few = text.filter(F.col("chars") < minimum)
    if cells is not None:
        few = few.join(cells.select(*PAGE).distinct(), PAGE, "left_anti")
    return few


def drop_scanned(blocks: DataFrame, scanned: DataFrame) -> DataFrame:
    return blocks.join(scanned.select(*PAGE), PAGE, "left_anti")


def table_lines(cells: DataFrame, *keys: str) -> DataFrame:
    """Markdown lines of tables given as cells (``keys``, row, col, cell), rows and columns from 0.

    Rows are padded or cut to the header's width; tables without a body row are dropped.
    """
    text = F.regexp_replace(F.coalesce(strip(F.col("cell")), F.lit("")), "\n", " ")
    rows = cells.groupBy(*keys, "row").agg(F.map_from_entries(F.collect_list(F.struct("col", text.alias("t")))).alias("m"),
                                          (F.max("col") + 1).alias("width"))
    table = Window.partitionBy(*keys)
    sized = rows.withColumn("header_width", F.max(F.when(F.col("row") == 0, F.col("width"))).over(table))
    sized = sized.withColumn("n_rows", F.count(F.lit(1)).over(table)).filter(F.col("n_rows") >= 2)

    def cell(i: Column) -> Column:
        value = F.coalesce(F.try_element_at("m", i), F.lit(""))
        named = F.when(value == "", F.concat(F.lit("Col_"), i + 1)).otherwise(value)
        return F.when(F.col("row") == 0, named).otherwise(value)

    span = F.sequence(F.lit(0), F.col("header_width") - 1)
    line = F.concat(F.lit("| "), F.array_join(F.transform(span, cell), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(span, lambda _: F.lit("---")), " | "), F.lit(" |"))
    lines = F.when(F.col("row") == 0, F.array(line, rule)).otherwise(F.array(line))
    out = sized.select(*keys, "row", F.posexplode(lines).alias("sub", "line"))
    return out.select(*keys, (F.col("row") + F.when(F.col("row") == 0, F.col("sub")).otherwise(1)).alias("line_no"), "line")


def table_markdown(cells: DataFrame, *keys: str) -> DataFrame:
    """One Markdown text per page table."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    return table_lines(cells, *keys).groupBy(*keys).agg(
        F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("markdown"),
        (F.count(F.lit(1)) - 2).alias("row_count"),
    )
