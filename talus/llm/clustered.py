"""A clustered layout over several dimensions: equal-depth coordinates, Morton order, files of a fixed number of rows.

Each dimension's values are counted, a running sum over the distinct values gives how many rows lie below each, and the
coordinates travel back to the rows by a join on the value. The coordinates' digits, interleaved, are the place z of a row
on the Morton curve. Rows are numbered along it by an offset for each z and a row number within it. Every row's query box is
a function of its cell, so the distinct cells are asked instead of the rows: they are joined with the boxes of the files,
equal in the dimensions that a query fixes and by range in the others.

What grows with the rows is dealt by ranges of its own order, so no value, cell or file gathers in one task: running sums
are taken within a range, and a table of one row a range (at most spark.sql.shuffle.partitions) carries them across. Cells
are at most 2 to the number of digits, 65,536 for four dimensions of 16 cells.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stage

CELLS, ROWS_PER_FILE = 16, 500


def sortable(value: Column, kind: T.DataType) -> Column:
    """A string that sorts by bytes as the value does: strings by UTF-8, whole numbers by size, null first."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.concat(F.lit("="), value), F.lit(""))
    return F.coalesce(F.lpad(F.hex(value.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit(""))


def morton(coordinates: list[Column], digits: int) -> Column:
    """The coordinates' binary digits interleaved, highest first, in the order given."""
    z = F.lit(0).cast("long")
    for digit in reversed(range(digits)):
        for c in coordinates:
            z = F.shiftleft(z, 1).bitwiseOR(F.shiftright(c.cast("long"), digit).bitwiseAND(F.lit(1)))
    return z


def coordinate(z: Column, place: int, dims: int, digits: int) -> Column:
    """The coordinate that stands at a place of the order, read back from z."""
    parts = (F.shiftleft(F.shiftright(z, dims * digit + dims - 1 - place).bitwiseAND(F.lit(1)), digit) for digit in range(digits))
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


def _ranged(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df staged in ranges of the order, with the number of each row's range."""
    return stage(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), name)


def _before(df: DataFrame, group: str, count: str) -> DataFrame:
    """For each group, the counts of all smaller groups together, and of all: groups are few, whatever the rows."""
    sums = df.groupBy(group).agg(F.sum(count).alias("_own"))
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(group, F.coalesce(F.sum("_own").over(earlier), F.lit(0)).alias("_before"), F.sum("_own").over(Window.partitionBy()).alias("_all"))


def coordinates(keys: DataFrame, dims: int, cells: int = CELLS) -> DataFrame:
    """(dim, key, c) of every distinct value: c is floor(cells * rows below / all rows). keys has columns k0, k1, ..."""
    values = keys.select(F.explode(F.array(*(F.struct(F.lit(i).alias("dim"), F.col(f"k{i}").alias("key")) for i in range(dims)))).alias("v")).select("v.*")
    counts = _ranged(values.groupBy("dim", "key").agg(F.count("*").alias("rows")), "layout-values", "dim", "key")
    within = Window.partitionBy("part").orderBy("dim", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = counts.withColumn("below", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(F.broadcast(_before(counts, "part", "rows")), "part")
    # each dimension counts all rows, so those of the dimensions before go from the running sum as a whole
    return stage(placed.select("dim", "key", F.expr(f"{cells} * (below + _before - dim * (_all div {dims})) div (_all div {dims})").cast("int").alias("c")), "layout-coordinates")


def _offsets(rows: DataFrame, digits: int) -> DataFrame:
    """(z, part, rows, start): where the rows of a cell within a range begin in the order of all."""
    counts = rows.groupBy("z", "part").agg(F.count("*").alias("rows")).withColumn("head", F.shiftright("z", digits // 2))
    within = Window.partitionBy("head").orderBy("z", "part").rowsBetween(Window.unboundedPreceding, -1)
    heads = F.broadcast(_before(counts, "head", "rows"))
    return stage(counts.withColumn("below", F.coalesce(F.sum("rows").over(within), F.lit(0))).join(heads, "head").select("z", "part", "rows", (F.col("below") + F.col("_before")).alias("start")), "layout-offsets")


def _touched(cells: DataFrame, bounds: DataFrame, order: list[str], reach: dict[str, int], top: int) -> DataFrame:
    """(z, files_touched): files whose bounds meet the cell's query box. Files of equal bounds are one row with their count."""
    edges = [f"{side}_{d}" for d in order for side in ("min", "max")]
    boxes = bounds.groupBy(*edges).agg(F.count("*").alias("files"))
    fixed = [d for d in order if not reach[d]] or order[:1]
    for d in fixed:
        boxes = boxes.withColumn(f"b_{d}", F.explode(F.sequence(F.greatest(F.col(f"min_{d}") - reach[d], F.lit(0)), F.least(F.col(f"max_{d}") + reach[d], F.lit(top)))))
    meets = [F.col(f"b_{d}") == F.col(f"c_{d}") for d in fixed]
    meets += [(F.col(f"min_{d}") <= F.col(f"c_{d}") + reach[d]) & (F.col(f"max_{d}") >= F.col(f"c_{d}") - reach[d]) for d in order if d not in fixed]
    return cells.join(boxes, reduce(lambda a, b: a & b, meets)).groupBy("z").agg(F.sum("files").alias("files_touched"))


def _matching(cells: DataFrame, order: list[str], reach: dict[str, int], top: int, digits: int) -> DataFrame:
    """(z, files_matching): files that hold a row in the cell's query box.

    The rows of a cell lie in files first .. last, so the answer is the length of a union of as many runs as the box has
    cells.
    """
    near = cells.select("z", *(f"c_{d}" for d in order))
    for d in order:
        if reach[d]:
            near = near.withColumn(f"c_{d}", F.explode(F.sequence(F.greatest(F.col(f"c_{d}") - reach[d], F.lit(0)), F.least(F.col(f"c_{d}") + reach[d], F.lit(top)))))
    near = near.select("z", morton([F.col(f"c_{d}") for d in order], digits).alias("other"))
    runs = near.join(cells.select(F.col("z").alias("other"), "first", "last"), "other").groupBy("z").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("runs"))
    count = F.aggregate(
        "runs",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("to")),
        lambda a, x: F.struct((a["n"] + F.greatest(x["last"] - F.greatest(x["first"] - 1, a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], x["last"]).alias("to")),
        lambda a: a["n"],
    )
    return runs.select("z", count.alias("files_matching"))


def layout(df: DataFrame, key: str, dims: dict[str, Column], order: list[str], reach: dict[str, int], rows_per_file: int = ROWS_PER_FILE, cells: int = CELLS) -> DataFrame:
    """(key, z, position, file, bounds, files_touched, files_matching) of every row of df.

    dims: the dimensions by name, strings or whole numbers. order: how their digits follow each other in a round. reach: how
    far a row's query goes from its own coordinate, 0 for equal ones. bounds: the file's (minimum, maximum) coordinate of
    each dimension, in the order of dims, as one array. files_touched and files_matching count the files whose bounds meet the row's query and
    those that hold a row in it.

    A null value is smaller than all others, an empty string the smallest string. Rows of equal z are numbered by key, null
    first; rows that also share the key are alike in all that is returned but their positions. Other columns of df, whatever
    their names, are not read. An empty table gives an empty result.
    """
    names, digits = list(dims), (cells - 1).bit_length()
    plain = df.select(F.col(key).alias("_key"), *(v.alias(f"v{i}") for i, v in enumerate(dims.values())))
    rows = stage(plain.select("_key", *(sortable(F.col(f"v{i}"), plain.schema[f"v{i}"].dataType).alias(f"k{i}") for i in range(len(names)))), "layout-keys")
    ranks = coordinates(rows, len(names), cells)
    for i in range(len(names)):
        rows = rows.join(ranks.filter(F.col("dim") == i).select(F.col("key").alias(f"k{i}"), F.col("c").alias(f"c{i}")), f"k{i}")
    z = morton([F.col(f"c{names.index(d)}") for d in order], digits)
    rows = _ranged(rows.select("_key", z.alias("z")), "layout-rows", "z", "_key")
    offsets = _offsets(rows, len(order) * digits)
    placed = rows.withColumn("_row", F.row_number().over(Window.partitionBy("z", "part").orderBy("_key"))).join(F.broadcast(offsets.drop("rows")), ["z", "part"])
    placed = placed.select("_key", "z", (F.col("start") + F.col("_row") - 1).alias("position")).withColumn("file", F.expr(f"position div {rows_per_file}"))

    first, last = F.min("start"), F.max(F.col("start") + F.col("rows")) - 1
    each = [coordinate(F.col("z"), i, len(order), digits).cast("int").alias(f"c_{d}") for i, d in enumerate(order)]
    asked = stage(offsets.groupBy("z").agg(F.expr("min(start)").alias("_f"), last.alias("_l")).select("z", *each, F.expr(f"_f div {rows_per_file}").alias("first"), F.expr(f"_l div {rows_per_file}").alias("last")), "layout-cells")
    sides = [f(f"c_{d}").alias(f"{side}_{d}") for d in order for side, f in (("min", F.min), ("max", F.max))]
    bounds = stage(asked.withColumn("file", F.explode(F.sequence("first", "last"))).groupBy("file").agg(*sides), "layout-files")
    answers = _touched(asked, bounds, order, reach, cells - 1).join(_matching(asked, order, reach, cells - 1, digits), "z")
    return (
        placed.join(F.broadcast(answers), "z")  # at most one row a cell
        .join(bounds.select("file", F.array(*(f"{side}_{d}" for d in names for side in ("min", "max"))).alias("bounds")), "file")
        .select(F.col("_key").alias(key), "z", "position", "file", "bounds", "files_touched", "files_matching")
    )


def document_dimensions() -> dict[str, Column]:
    """Source, language, length of the text in bytes of UTF-8 (-1 for null) and a day that the id's checksum stands for."""
    return {
        "source": F.col("source"),
        "lang": F.col("lang"),
        "length": F.coalesce(F.octet_length("text"), F.lit(-1)).cast("long"),
        "date": (F.crc32(F.col("doc_id").cast("string")) % 365).cast("long"),
    }


def document_layout(docs: DataFrame) -> DataFrame:
    """layout() of documents: queries ask for one source and language, and for lengths and dates near their own."""
    return layout(docs, "doc_id", document_dimensions(), ["length", "source", "date", "lang"], {"source": 0, "lang": 0, "length": 2, "date": 2})


def write(df: DataFrame, key: str, placed: DataFrame, folder: str, rows_per_file: int = ROWS_PER_FILE, files_per_task: int = 64) -> None:
    """The rows of df as Parquet in the order of a layout, rows_per_file to a file, with their position, file and z.

    key must be unique and not null; a repeated key is an error, since either row could take either place. Columns of df that
    are named position, file or z give way to those of the layout.
    """
    places = placed.select(F.col(key).alias("_key"), "position", "file", "z")
    once = Window.partitionBy("_key")
    places = places.withColumn("file", F.when(F.count("*").over(once) == 1, F.col("file")).otherwise(F.raise_error(F.lit(f"{key} is not unique"))))
    rows = df.drop("position", "file", "z").join(places, F.col(key) == F.col("_key")).drop("_key")
    # a task's rows begin with a whole file, so cutting after every rows_per_file rows cuts between files
    run = F.expr(f"file div {files_per_task}")
    rows.repartitionByRange(run).sortWithinPartitions("position").write.option("maxRecordsPerFile", rows_per_file).parquet(folder)


def read(spark: SparkSession, folder: str, low: int, high: int) -> DataFrame:
    """Rows of the cells low <= z <= high of a written layout; files outside are passed over by their footers."""
    return spark.read.parquet(folder).filter(F.col("z").between(low, high))


_CRC = "list_reduce([4294967295] || list_transform(range(length(id)), lambda i: ascii(id[i + 1])::BIGINT), lambda a, b: list_reduce([xor(a, b)] || range(8), lambda x, _: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"


def oracle_sql() -> str:
    """document_layout() in DuckDB, with the bounds as one string."""
    rank = {d: f"(16 * (rank() OVER (ORDER BY {v} NULLS FIRST) - 1)) // count(*) OVER ()" for d, v in {"s": "source", "g": "lang", "l": "bytes", "d": "day"}.items()}
    z = " + ".join(f"(({d} // {2**k}) % 2) * {2 ** (4 * k + 3 - i)}" for k in range(4) for i, d in enumerate("lsdg"))
    sides = ", ".join(f"min({d}) AS {d}0, max({d}) AS {d}1" for d in "sgld")
    joined = " || ',' || ".join(f"{d}{e}" for d in "sgld" for e in (0, 1))
    return f"""
WITH t AS (SELECT doc_id, source, lang, CASE WHEN text IS NULL THEN -1 ELSE strlen(text) END AS bytes, doc_id::VARCHAR AS id FROM documents),
v AS (SELECT doc_id, source, lang, bytes, CASE WHEN id IS NOT NULL THEN xor({_CRC}, 4294967295) % 365 END AS day FROM t),
c AS (SELECT doc_id, {", ".join(f"({r})::BIGINT AS {d}" for d, r in rank.items())} FROM v),
m AS (SELECT *, ({z})::BIGINT AS z FROM c),
p AS (SELECT *, row_number() OVER (ORDER BY z, doc_id NULLS FIRST) - 1 AS position FROM m),
f AS (SELECT *, position // 500 AS file FROM p),
b AS (SELECT file, {sides} FROM f GROUP BY file),
q AS (SELECT DISTINCT z, s, g, l, d FROM f),
touched AS (SELECT q.z, count(*) AS n FROM q JOIN b ON q.s BETWEEN s0 AND s1 AND q.g BETWEEN g0 AND g1 AND l0 <= q.l + 2 AND l1 >= q.l - 2 AND d0 <= q.d + 2 AND d1 >= q.d - 2 GROUP BY q.z),
held AS (SELECT DISTINCT s, g, l, d, file FROM f),
matching AS (SELECT q.z, count(DISTINCT h.file) AS n FROM q JOIN held h ON q.s = h.s AND q.g = h.g AND abs(q.l - h.l) <= 2 AND abs(q.d - h.d) <= 2 GROUP BY q.z)
SELECT doc_id, f.z, position::BIGINT AS position, f.file::BIGINT AS file, touched.n::BIGINT AS files_touched, matching.n::BIGINT AS files_matching, {joined} AS file_bounds
FROM f JOIN b USING (file) JOIN touched ON touched.z = f.z JOIN matching ON matching.z = f.z
"""
