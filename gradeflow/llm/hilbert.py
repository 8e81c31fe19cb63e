"""Sharding along a Hilbert curve (operator 2). DataFrame functions only.

Metadata dimensions are quantised at their own quantiles, the cells are numbered by the curve
that passes through them, rows are sorted by that number, and the sorted order is cut into
runs. Rows near each other in several dimensions share a run, so a reader that knows each
file's smallest and largest values skips most files for a filter on any of them.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import dropped, written


def as_number(df: DataFrame, name: str) -> Column:
    """A long that keeps the order of a column of numbers or times. Null comes first."""
    kind, col = dict(df.dtypes)[name], F.col(f"`{name}`")
    if kind in ("timestamp", "date", "timestamp_ntz"):
        value = F.unix_micros(col.cast("timestamp"))
    else:
        value = (F.floor(col) if kind in ("double", "float") or kind.startswith("decimal") else col).try_cast("long")
    return F.coalesce(value, F.lit(-(2**62)).cast("long"))


def text_cuts(df: DataFrame, name: str, cells: int) -> list[str]:
    """The least value of each cell but the lowest, where values in order are dealt to ``cells`` cells of equal row counts.

    Values are counted first; their places are prefix sums over the partitions of a range
    sort. At most ``cells`` values come to the driver.
    """
    counts = df.select(F.col(f"`{name}`").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    ordered = written(counts.repartitionByRange("v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()), "hilbert-values")
    part = F.shiftrightunsigned("at", 33).cast("int")
    own = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = ordered.groupBy(part.alias("part")).agg(F.sum("n").alias("rows"))
    # a row for each partition of the sort, whatever the size of the input
    every = sums.agg(F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("parts"), F.sum("rows").alias("total"))
    before = F.aggregate("parts", F.lit(0).cast("long"), lambda t, p: t + F.when(p["part"] < F.col("part"), p["rows"]).otherwise(0))
    placed = ordered.withColumn("part", part).join(F.broadcast(every)).withColumn("cell", F.floor((before + F.sum("n").over(own) - F.col("n")) * cells / F.col("total")))
    cuts = [r.v for r in placed.groupBy("cell").agg(F.min("v").alias("v")).orderBy("cell").collect()]
    dropped(ordered)
    return cuts[1:]


def hilbert_index(axes: list[Column], bits: int) -> Column:
    """The place on the Hilbert curve of cells given by ``axes`` (longs of ``bits`` bits).

    The coordinates are turned into the transposed index bit by bit from the top (exchange
    or invert the lower bits of the first axis), Gray-coded, and their bits interleaved.
    """
    n = len(axes)
    if n * bits > 62:
        raise ValueError("more than 62 bits")
    x = F.array(*[a.cast("long") for a in axes])
    steps = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)]) if bits > 1 else None

    def turn(x: Column, s: Column) -> Column:
        low = s["q"] - F.lit(1).cast("long")
        on = F.get(x, s["i"]).bitwiseAND(s["q"]) != 0
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, s["i"])).bitwiseAND(low)
        first = F.when(on, F.get(x, F.lit(0)).bitwiseXOR(low)).otherwise(F.get(x, F.lit(0)).bitwiseXOR(swap))
        return F.transform(x, lambda v, j: F.when(j == 0, first).when((j == s["i"]) & ~on, v.bitwiseXOR(swap)).otherwise(v))

    if steps is not None:
        x = F.aggregate(steps, x, turn)
    # Gray code: each axis with all before it
    x = F.aggregate(F.array(*[F.lit(i) for i in range(1, n)]), x, lambda a, i: F.transform(a, lambda v, j: F.when(j == i, v.bitwiseXOR(F.get(a, i - 1))).otherwise(v))) if n > 1 else x
    if bits > 1:
        tops = F.array(*[F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)])
        packed = F.struct(x.alias("x"), F.aggregate(tops, F.lit(0).cast("long"), lambda t, q: F.when(F.get(x, F.lit(n - 1)).bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t)).alias("t"))
        x = F.aggregate(F.array(packed), F.array().cast("array<long>"), lambda _, p: F.transform(p["x"], lambda v: v.bitwiseXOR(p["t"])))
    order = F.array(*[F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(n)])
    packed = F.array(F.struct(x.alias("x")))
    return F.aggregate(packed, F.lit(0).cast("long"), lambda _, p: F.aggregate(order, F.lit(0).cast("long"), lambda h, s: h * 2 + (F.get(p["x"], s["i"]).bitwiseAND(s["q"]) != 0).cast("long")))


def quantised(df: DataFrame, dims: list[str], bits: int) -> DataFrame:
    """Columns _q0, _q1, ...: the cell of each dimension, cut at quantiles over all rows.

    Texts are cut at whole values, in binary order, so values that begin alike fall into cells of their own.
    """
    kinds, cells = dict(df.dtypes), 1 << bits
    texts = {i: text_cuts(df, d, cells) for i, d in enumerate(dims) if kinds[d] == "string"}
    numbers = [i for i in range(len(dims)) if i not in texts]
    share = [k / cells for k in range(1, cells)]
    cuts = df.agg(*[F.percentile_approx(as_number(df, dims[i]), share, 1000).alias(f"_v{i}") for i in numbers]).first() if numbers else []
    edges = texts | {i: sorted(set(c or [])) for i, c in zip(numbers, cuts, strict=True)}
    out = df
    for i, d in enumerate(dims):
        value = F.col(f"`{d}`") if i in texts else as_number(df, d)
        # a value falls above every cut that is not larger; null below all; at most 2^bits - 1 cuts
        below = [F.when(F.lit(e) <= value, 1).otherwise(0) for e in edges[i]]
        out = out.withColumn(f"_q{i}", reduce(add, below, F.lit(0)).cast("long"))
    return out


def hilbert_shards(docs: DataFrame, *, shards: int = 8, dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Put all rows into ``shards`` runs along the curve, row counts at most one apart.

    Returns (id, size, text_crc32, curve, shard, slot): UTF-8 bytes of the text plus one (null:
    one), the unsigned crc32 of the text (null: of the empty text), the place on the curve, the
    run and the place in it from 0. Rows with one place on the curve follow their crc, size
    and id, so equal texts with equal metadata stand together and a source with a third of all
    rows is cut like any other stretch. Null dimensions come first. An empty table has no rows.
    Texts themselves are not moved: ids and numbers are sorted, and joined back by whoever
    writes files (``write_shards``).
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = [F.col(f"`{d}`").alias(f"dim{i}") for i, d in enumerate(dims)]
    # texts are read once; all else runs on these slim rows
    slim = written(docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), *own), "hilbert-slim")
    slim = quantised(slim, [f"dim{i}" for i in range(len(dims))], bits)
    slim = slim.select("_id", "size", "text_crc32", hilbert_index([F.col(f"_q{i}") for i in range(len(dims))], bits).alias("curve"))
    order = ["curve", "text_crc32", "size", "_id"]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    # place in the order: (partition, place in it), fixed by writing it down once
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "hilbert")
    part, own = F.shiftrightunsigned("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("rows"))
    # a row for each partition of the sort, so few whatever the size of the input
    every = counts.agg(F.map_from_entries(F.collect_list(F.struct("_part", "rows"))).alias("m"), F.sum("rows").alias("total"))
    before = every.select("total", F.explode("m").alias("_part", "rows"), "m").select("_part", "total", F.aggregate(F.map_entries("m"), F.lit(0).cast("long"), lambda t, e: t + F.when(e["key"] < F.col("_part"), e["value"]).otherwise(0)).alias("before"))
    rank = F.col("before") + F.col("_own")
    out = placed.withColumns({"_part": part, "_own": own}).join(F.broadcast(before), "_part").withColumn("_rank", rank)
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    out = out.withColumn("shard", F.expr(f"_rank * {shards} div total").cast("int")).withColumn("slot", F.col("_rank") - first)
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", "curve", "shard", "slot")


def write_shards(docs: DataFrame, shards: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", rows_per_file: int = 1_000_000) -> None:
    """Write the documents as Parquet, a folder for each shard, rows in curve order.

    The assignment is joined back by id (null too), size and crc of the text; where rows
    agree in all three, each takes one of their places, so every row is written once. Columns may
    have any names but ``shard``, which names the folders.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc_id, text = (F.col(f"c{names.index(c)}") for c in (id_col, text_col))
    text = F.coalesce(text.cast("string"), F.lit(""))
    keyed = plain.withColumns({"own_id": doc_id.cast("long"), "own_size": (F.octet_length(text) + 1).cast("long"), "own_crc": F.crc32(text.cast("binary"))})
    keyed = keyed.withColumn("nth", F.row_number().over(Window.partitionBy("own_id", "own_size", "own_crc").orderBy(F.lit(0))))
    held = shards.select(F.col(id_col).cast("long").alias("i"), "size", F.col("text_crc32").alias("crc"), "shard", "slot")
    held = held.withColumn("place", F.row_number().over(Window.partitionBy("i", "size", "crc").orderBy("shard", "slot")))
    joined = keyed.join(held, F.col("own_id").eqNullSafe(F.col("i")) & (F.col("own_size") == F.col("size")) & (F.col("own_crc") == F.col("crc")) & (F.col("nth") == F.col("place")))
    runs = joined.select(*plain.columns, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("slot")
    runs.toDF(*names, "shard").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
