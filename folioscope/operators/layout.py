"""Page geometry: rows of glyphs, notes and page numbers, column gutters.

glyphs: source_id, pdf_page, glyph_pos, ch, top, x0, x1, size; dims: source_id,
pdf_page, width, height.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import text as T

# Fixed values of the heuristics.
ROW, HEAD, FOOT, BODY_FOOT, NOTE_TOP, NOTE_SIZE, NOTE_LENGTH, NEAR = 3, 0.08, 0.88, 0.90, 0.72, 0.88, 12, 4
BANDS = [(0.65, 0.95), (0.35, 0.90)]
LEFT_EDGE, RIGHT_EDGE, ENOUGH, RUN, LOW, SIDE, PAIRED = 0.45, 0.56, 150, 5, 2, 0.20, 5
PAGE = ["source_id", "pdf_page"]


def glyph_rows(glyphs: DataFrame) -> DataFrame:
    """Rows of glyphs by rounded height: y, line (in x order), raw (in glyph order), max_size."""
    seen = glyphs.where(T.strip(F.col("ch")) != "").withColumn("y", (F.rint(F.col("top") / ROW) * ROW).cast("int"))
    text = lambda key: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(key, "glyph_pos", "ch"))), lambda g: g["ch"]), "")
    return seen.groupBy(*PAGE, "y").agg(text("x0").alias("line"), text("glyph_pos").alias("raw"), F.max("size").alias("max_size"), F.min("glyph_pos").alias("first"))


def page_flow(glyphs: DataFrame, dims: DataFrame) -> DataFrame:
    """glyph_rows with role (main, number, head, note, near_note) and print_page; all but main are ancillary."""
    seen = glyphs.where(T.strip(F.col("ch")) != "").join(dims, PAGE)
    body = seen.where((F.col("top") > F.col("height") * HEAD) & (F.col("top") < F.col("height") * BODY_FOOT))
    sizes = body.withColumn("sz", F.bround("size", 1)).groupBy(*PAGE, "sz").agg(F.count("*").alias("n"), F.min("glyph_pos").alias("first"))
    typical = sizes.groupBy(*PAGE).agg(F.max_by("sz", F.struct("n", (-F.col("first")).alias("f"))).alias("typical"))
    rows = glyph_rows(glyphs).join(dims, PAGE).join(typical, PAGE, "left").withColumn("line", T.strip(F.col("line")))
    note = (F.col("y") > F.col("height") * NOTE_TOP) & (F.coalesce("typical", F.lit(0.0)) > 0) & (F.col("max_size") <= F.col("typical") * NOTE_SIZE) & (F.length(T.strip(F.col("raw"))) > NOTE_LENGTH)
    rows = rows.withColumn("is_note", F.coalesce(note, F.lit(False)))
    # heights are multiples of ROW, so those within NEAR of a note are its own and its neighbours'
    by_page = Window.partitionBy(*PAGE).orderBy("y").rangeBetween(-NEAR, NEAR)
    rows = rows.withColumn("near", F.max("is_note").over(by_page))
    number = (F.col("y") > F.col("height") * FOOT) & F.col("line").rlike(r"(?U)^[·.\-—\s]*\d{1,4}[·.\-—\s]*\z")
    role = F.when(number, "number").when(F.col("y") < F.col("height") * HEAD, "head").when(F.col("is_note"), "note").when(F.col("near") & (F.length("line") <= NOTE_LENGTH), "near_note").otherwise("main")
    rows = rows.withColumn("role", role)
    # rows are met in the order of their first glyphs; the last number stands
    printed = F.max_by(F.when(F.col("role") == "number", F.regexp_extract("line", r"(?U)(\d{1,4})", 1)), F.when(F.col("role") == "number", F.col("first"))).over(Window.partitionBy(*PAGE))
    return rows.select(*PAGE, "y", "line", "role", printed.alias("print_page"))


def flow_text(rows: DataFrame) -> DataFrame:
    """Main and ancillary text of each page, rows from top to bottom."""
    part = lambda main: F.array_join(F.transform(F.sort_array(F.collect_list(F.when((F.col("role") == "main") == F.lit(main), F.struct("y", "line")))), lambda x: x["line"]), "\n")
    return rows.groupBy(*PAGE).agg(part(True).alias("text"), part(False).alias("ancillary_text"), F.first("print_page").alias("print_page"))


def gutters(glyphs: DataFrame, dims: DataFrame) -> DataFrame:
    """The gutter of each page, null where none is sure: the longest run of whole x that hardly any glyph covers."""
    seen = glyphs.where(T.strip(F.col("ch")) != "").join(dims, PAGE)
    out = None
    for turn, (low, high) in enumerate(BANDS):
        band = seen.where((F.col("top") > F.col("height") * low) & (F.col("top") < F.col("height") * high))
        # a glyph covers whole x strictly between its edges: a short sequence, not a join by range
        first, last = F.floor(F.col("width") * LEFT_EDGE).cast("int"), F.floor(F.col("width") * RIGHT_EDGE).cast("int") - 1
        a, b = F.greatest(first, (F.floor("x0") + 1).cast("int")), F.least(last, (F.ceil("x1") - 1).cast("int"))
        covered = band.where(a <= b).select(*PAGE, F.explode(F.sequence(a, b)).alias("x")).groupBy(*PAGE, "x").agg(F.count("*").alias("n"))
        pages = band.groupBy(*PAGE).agg(F.count("*").alias("glyphs"), F.first("width").alias("width")).where(F.col("glyphs") > ENOUGH)
        spots = pages.select(*PAGE, "glyphs", F.explode(F.sequence(first, last)).alias("x")).join(covered, [*PAGE, "x"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        spots = spots.withColumn("low", F.min("n").over(Window.partitionBy(*PAGE))).where(F.col("n") <= F.col("low") + 1)
        spots = spots.withColumn("island", F.col("x") - F.row_number().over(Window.partitionBy(*PAGE).orderBy("x")))
        runs = spots.groupBy(*PAGE, "island", "low", "glyphs").agg(F.min("x").alias("a"), F.max("x").alias("b"), F.count("*").alias("len"))
        best = runs.groupBy(*PAGE, "low", "glyphs").agg(F.max_by(F.struct("a", "b", "len"), F.struct("len", (-F.col("a")).alias("f"))).alias("r"))
        best = best.select(*PAGE, "low", "glyphs", ((F.col("r.a") + F.col("r.b")) / 2).alias("mid"), F.col("r.len").alias("len")).where((F.col("len") >= RUN) & (F.col("low") <= LOW))
        sides = band.join(best, PAGE).groupBy(*PAGE, "mid", "glyphs").agg(F.sum((F.col("x1") <= F.col("mid")).cast("long")).alias("left"), F.sum((F.col("x0") >= F.col("mid")).cast("long")).alias("right"))
        good = sides.where(F.least("left", "right") >= F.col("glyphs") * SIDE).select(*PAGE, F.lit(turn).alias("turn"), "mid")
        out = good if out is None else out.unionByName(good)
    chosen = out.groupBy(*PAGE).agg(F.min_by("mid", "turn").alias("gutter"))
    y = (F.rint(F.col("top") / ROW) * ROW).cast("int").alias("y")
    rows = seen.join(chosen, PAGE).groupBy(*PAGE, "gutter", y).agg(F.bool_or(F.col("x1") < F.col("gutter") - 2).alias("l"), F.bool_or(F.col("x0") > F.col("gutter") + 2).alias("r"), F.bool_or((F.col("x0") < F.col("gutter")) & (F.col("gutter") < F.col("x1"))).alias("over"))
    paired = rows.where("l AND r AND NOT over").groupBy(*PAGE, "gutter").agg(F.count("*").alias("rows"), F.min("y").alias("first"), F.max("y").alias("last")).where(F.col("rows") >= PAIRED)
    return dims.join(paired, PAGE, "left").select(*PAGE, F.when(F.col("gutter").isNull(), "single_or_uncertain").otherwise("two_column_candidate").alias("layout"), F.bround("gutter", 2).alias("gutter"), (F.col("first") - 2).alias("top"), (F.col("last") + 16).alias("bottom"))


def layout_text(glyphs: DataFrame, dims: DataFrame) -> DataFrame:
    """Text of each page in reading order: above the columns, left, right, below; one part where there is no gutter."""
    found = gutters(glyphs, dims).drop("layout")
    mid = (F.col("x0") + F.col("x1")) / 2
    part = F.when(F.col("gutter").isNull(), 0).when(F.col("top") < F.col("found_top"), 0).when(F.col("top") >= F.col("bottom"), 3).when(mid < F.col("gutter"), 1).otherwise(2)
    placed = glyphs.where(T.strip(F.col("ch")) != "").join(found.withColumnRenamed("top", "found_top"), PAGE).withColumn("part", part)
    rows = placed.withColumn("y", (F.rint(F.col("top") / ROW) * ROW).cast("int")).groupBy(*PAGE, "part", "y").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "glyph_pos", "ch"))), lambda g: g["ch"]), "").alias("line"))
    return rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "y", "line"))), lambda x: x["line"]), "\n").alias("text"))
