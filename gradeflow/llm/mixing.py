"""Mixing sources to target weights (operator 10). DataFrame functions only.

A source's weight is its share of all tokens to the power of an exponent, normalised. The
exponent is bisected: downward from one until the weights' entropy reaches a target, or
upward from zero until no source is repeated more often than a limit. A token budget is then
dealt out: each source's documents are cut into blocks by a hash, each pass over the source
takes its blocks in an order of its own, and passes are taken whole until the source's part of
the budget runs out inside a pass, inside a block. Ids, hashes and token counts are written once;
all windows run on these slim rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.llm.common import written

ROUNDS = 60


def token_count(text: Column) -> Column:
    """Words between ASCII white space; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, *, target_entropy: float | None = None, most_repeats: float | None = None, budget: int | str = "corpus") -> DataFrame:
    """(source, tokens, docs, alpha, weight, budget, repeats) from (source, tokens, docs).

    ``target_entropy`` is a part (0 to 1) of the largest entropy, that of equal weights; the
    exponent is the largest in [0, 1] that reaches it. ``most_repeats`` limits budget / tokens of
    every source; the exponent is the least in [0, 1] that keeps to it. With both the limit
    has the last word. ``budget`` is a number of tokens, ``corpus`` for as many as there are, or
    ``cover`` for the least with which every source is passed over once. Sources without
    tokens have weight 0. One row for each source is gathered into one list, on one executor.
    """
    if target_entropy is None and most_repeats is None:
        raise ValueError("give target_entropy or most_repeats")
    named = sizes.select("source", "tokens", "docs")
    every = named.agg(F.collect_list(F.when(F.col("tokens") > 0, F.col("tokens").cast("double"))).alias("t"), F.sum("tokens").cast("double").alias("total"))
    # shares as numbers; the order of the list plays no part
    every = every.withColumn("s", F.array_sort(F.transform("t", lambda x: x / F.col("total"))))

    def added(array: Column, f) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda a, x: a + f(x))

    def entropy(s: Column, alpha: Column) -> Column:
        # H = ln Z - alpha * sum(s^alpha ln s) / Z
        z = added(s, lambda x: F.pow(x, alpha))
        return F.log(z) - alpha * added(s, lambda x: F.pow(x, alpha) * F.log(x)) / z

    def repeats(s: Column, alpha: Column) -> Column:
        """Most passes over a source: the smallest share's s^(alpha - 1) times the budget in corpora, over Z."""
        z = added(s, lambda x: F.pow(x, alpha))
        per = F.pow(F.array_min(s), alpha - 1) / z
        if budget == "cover":
            return F.pow(F.array_min(s), alpha - 1) / F.pow(F.array_max(s), alpha - 1)
        return per * (F.lit(1.0) if budget == "corpus" else F.lit(float(budget)) / F.col("total"))

    def bisect(good, keep_low: bool) -> Column:
        def half(b: Column, _: Column) -> Column:
            mid = (b["lo"] + b["hi"]) / 2
            up = good(mid) if keep_low else ~good(mid)
            return F.struct(F.when(up, mid).otherwise(b["lo"]).alias("lo"), F.when(up, b["hi"]).otherwise(mid).alias("hi"))

        ends = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi")), half)
        return ends["lo"] if keep_low else ends["hi"]

    s = F.col("s")
    alpha = F.lit(0.0)
    if target_entropy is not None:
        reached = lambda a: entropy(s, a) >= target_entropy * F.log(F.size(s).cast("double"))
        alpha = F.when(reached(F.lit(1.0)), F.lit(1.0)).otherwise(bisect(reached, True))
    every = every.withColumn("a", alpha)
    if most_repeats is not None:
        held = lambda a: repeats(s, a) <= most_repeats
        every = every.withColumn("a", F.greatest("a", F.when(held(F.lit(0.0)), 0.0).otherwise(bisect(held, False))))
    z = every.withColumn("z", added(s, lambda x: F.pow(x, F.col("a"))))
    if budget == "cover":
        # every source's part is its tokens at least: the tightest is the largest source
        amount = F.col("total") * F.col("z") * F.pow(F.array_max(s), 1 - F.col("a"))
    else:
        amount = F.col("total") if budget == "corpus" else F.lit(float(budget))
    z = z.select(F.col("a").alias("alpha"), "z", "total", amount.alias("amount"))
    out = named.join(F.broadcast(z))  # one row
    weight = F.when(F.col("tokens") > 0, F.pow(F.col("tokens") / F.col("total"), F.col("alpha")) / F.col("z")).otherwise(0.0)
    out = out.withColumn("weight", weight).withColumn("budget", F.round(F.col("weight") * F.col("amount")).cast("long"))
    return out.select("source", "tokens", "docs", "alpha", "weight", "budget", F.coalesce(F.try_divide(F.col("budget").cast("double"), F.col("tokens")), F.lit(0.0)).alias("repeats"))


def row_hash(id_: Column, text: Column, salt: int) -> Column:
    """60 bits of the sha256 of salt, id and md5 of the text; any SQL engine can compute them."""
    said = F.concat_ws(":", F.lit(str(salt)), F.coalesce(id_.cast("string"), F.lit("")), F.coalesce(F.md5(text.cast("binary")), F.lit("")))
    return F.conv(F.substring(F.sha2(said, 256), 1, 15), 16, 10).cast("long")


def _keys(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    """What tells rows apart here: source as text (null is a source too), id, and a hash of id and text."""
    text = F.col(f"`{text_col}`").cast("string")
    return {"mix_source": F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`").cast("string")), F.lit("null")), "mix_id": F.col(f"`{id_col}`"), "mix_hash": row_hash(F.col(f"`{id_col}`"), text, 5)}


def _units(slim: DataFrame, weights: DataFrame, block_docs: int) -> DataFrame:
    """Distinct rows with their block, its turn in the last pass, the tokens before them in that pass, and their copies."""
    plan = weights.select(F.col("source").alias("mix_source"), "weight", "repeats", F.greatest(F.lit(1), F.ceil(F.col("docs") / block_docs)).cast("int").alias("blocks"), F.when(F.col("tokens") > 0, F.floor(F.col("repeats"))).otherwise(1).cast("long").alias("passes"), F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(0).cast("long").alias("rest"))
    units = slim.groupBy("mix_source", "mix_id", "mix_hash").agg(F.count("*").alias("rows"), F.sum("tokens").alias("held"))
    # a row for each source
    units = units.join(F.broadcast(plan), "mix_source").withColumn("block", F.pmod("mix_hash", "blocks").cast("int"))

    # the last pass takes the blocks in an order of its own
    order = F.sha2(F.concat_ws(":", "mix_source", F.col("block").cast("string"), F.col("passes").cast("string")), 256)
    turns = Window.partitionBy("mix_source").orderBy(order, "block")
    blocks = units.groupBy("mix_source", "block", "passes").agg(F.sum("held").alias("sum"))
    blocks = blocks.select("mix_source", "block", F.row_number().over(turns).alias("turn"), (F.sum("sum").over(turns.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")).alias("before"))
    units = units.join(blocks, ["mix_source", "block"])
    inside = Window.partitionBy("mix_source", "block").orderBy("mix_hash", "mix_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    start = F.col("before") + F.sum("held").over(inside) - F.col("held")
    units = units.withColumn("start", start)
    once_more = (F.col("held") > 0) & (F.col("start") + F.col("held") <= F.col("rest"))
    named = [F.col(c).alias(f"unit_{c}") for c in ("mix_source", "mix_id", "mix_hash")]  # apart from the rows' own in a join
    return units.select(*named, "weight", "repeats", "passes", "block", "turn", "start", (F.col("passes") + F.when(once_more, 1).otherwise(0)).alias("copies"))


def mixed(docs: DataFrame, *, target_entropy: float | None = None, most_repeats: float | None = None, budget: int | str = "corpus", block_docs: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """How often the mixture takes each row of ``docs``, and where it stands in it.

    Returns a row for each row: (id, source, tokens, weight, repeats, passes, block, turn, start,
    copies). Each row is taken in each whole pass over its source, and once more if the last, cut
    pass reaches it: that pass takes the source's blocks in ``turn``, an order of its own, and the
    documents of a block by hash; ``start`` counts the tokens before the row in it, and what ends
    within the budget's rest is taken, so a source takes its budget to within one document. Equal
    rows (source, id and text) stand together and are taken alike. Rows without tokens (null or
    empty texts) cost nothing and go with the whole passes; in a source without tokens every row
    is taken once. Null is a source like any other. No row is dropped: those not taken have 0
    copies. Other columns of ``docs``, whatever their names, play no part. Texts are read once and never moved.
    """
    slim = written(docs.select(*[c.alias(n) for n, c in _keys(docs, id_col, text_col, source_col).items()], F.col(f"`{source_col}`").alias("mix_named"), token_count(F.col(f"`{text_col}`").cast("string")).alias("tokens")), "mixing")
    units = _units(slim, _weights(slim, target_entropy, most_repeats, budget), block_docs)
    # row by row again; null ids are equal to each other
    key = [F.col(c).eqNullSafe(F.col(f"unit_{c}")) for c in ("mix_source", "mix_id", "mix_hash")]
    return slim.join(units, key).select(F.col("mix_id").alias(id_col), F.col("mix_named").alias(source_col), "tokens", "weight", "repeats", "passes", "block", "turn", "start", "copies")


def drawn(docs: DataFrame, *, least: int = 0, target_entropy: float | None = None, most_repeats: float | None = None, budget: int | str = "corpus", block_docs: int = 256, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mixture itself: ``docs`` with each row as often as ``mixed`` takes it, ``least`` times at least.

    Columns stay as they are, whatever their names. Each text is moved once.
    """
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    cols = {k: f"c{names.index(v)}" for k, v in (("id_col", id_col), ("text_col", text_col), ("source_col", source_col))}
    keys = _keys(plain, **cols)
    slim = written(plain.select(*[c.alias(n) for n, c in keys.items()], token_count(F.col(cols["text_col"]).cast("string")).alias("tokens")), "mixing")
    units = _units(slim, _weights(slim, target_entropy, most_repeats, budget), block_docs)
    taken = units.select(*[f"unit_{c}" for c in keys], F.greatest(F.lit(least), F.col("copies")).cast("int").alias("copies")).where("copies > 0")
    rows = plain.withColumns(keys)
    both = rows.join(taken, [F.col(c).eqNullSafe(F.col(f"unit_{c}")) for c in keys])
    return both.withColumn("mix_n", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*plain.columns).toDF(*names)


def _weights(slim: DataFrame, target_entropy: float | None, most_repeats: float | None, budget: int | str) -> DataFrame:
    sizes = slim.groupBy(F.col("mix_source").alias("source")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs"))
    return source_weights(sizes, target_entropy=target_entropy, most_repeats=most_repeats, budget=budget)
