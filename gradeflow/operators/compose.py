"""Composing evaluation sets: labels, pools, samples, quotas and order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeflow.sources.scratch import checkpointed

# Names of question types and topics, and the words that point to them, the first that fits.
QUESTION_TYPES = (
    ("민감", ("민감", "sensitive")),
    ("수치추론/계산", ("수치", "numerical", "numeric", "calculation", "계산")),
    ("복합추론", ("복합", "multi-hop", "multihop", "multi hop")),
    ("비교대조", ("비교", "comparison", "compare", "대조")),
    ("단일추론(사실추출)", ("단일", "사실", "single", "fact")),
)
TOPICS = (
    ("카드/결제", ("카드/결제", "card", "payment", "결제", "카드")),
    ("대출/여신", ("대출", "여신", "loan", "credit")),
    ("예적금", ("예적금", "예/적금", "예금", "적금", "deposit", "savings")),
    ("투자/펀드", ("투자", "펀드", "investment", "fund")),
)


def labelled(values: list[Column], rules: tuple, own: Column | None = None, rest: str | None = None) -> Column:
    """The first label one of whose words the values hold; else what ``own`` says, else ``rest`` or the last label (P10)."""
    text = F.lower(F.concat_ws(" ", *[F.coalesce(v.cast("string"), F.lit("")) for v in values]))
    out = F.when(F.lit(False), "")
    for label, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | text.contains(w)
        out = out.when(hit, label)
    otherwise = F.lit(rest or rules[-1][0])
    return out.otherwise(F.coalesce(F.nullif(F.trim(own), F.lit("")), otherwise) if own is not None else otherwise)


@dataclass(frozen=True)
class Pool:
    """A pool of cases, how many it gives, and what its cases are marked with."""

    pool_id: str
    quota: int
    role: str = "regression"
    gate_eligible: bool | None = None
    prefix: str = ""
    version: str = "v0"
    public: bool = False
    defaults: dict[str, str] = field(default_factory=dict)

    @property
    def gates(self) -> bool:
        return self.role != "benchmark" if self.gate_eligible is None else self.gate_eligible


def case_ids(rows: DataFrame, names: tuple[str, ...] = ("case_id", "scenario_id", "id")) -> Column:
    """The id of a case, or one made from a hash of the whole row."""
    made = F.concat(F.lit("COMPOSED-"), F.upper(F.substring(F.sha1(F.to_json(F.struct(*sorted(rows.columns)))), 1, 12)))
    return F.coalesce(*[F.nullif(F.trim(F.col(n).cast("string")), F.lit("")) for n in names if n in rows.columns], made)


def lifecycle_defaults(status: Column, gold: Column, gates: Column | bool, release: Column | None = None, review: Column | None = None) -> dict[str, Column]:
    """Whether a case may gate a release and whether people must see it, where it does not say so itself."""
    can, gates = (status == "active") & gold, gates if isinstance(gates, Column) else F.lit(gates)
    said = F.coalesce(release, gates) if release is not None else gates
    needs = status.isin("draft", "shadow") | ~gold
    return {"release_gate_eligible": said & can, "human_review_required": F.coalesce(review, needs) if review is not None else needs}


def annotated(cases: DataFrame, pool: Column, defaults: list[str], seed: str, profile: str = "", source_hash: str = "") -> DataFrame:
    """Cases with prefixed ids and the role, version, hash, seed, profile and lifecycle of their pools.

    ``pool`` is a struct of role, gates, prefix, version, public and a map of defaults, of which the named
    ones become columns. Takes pool_id, case_status and gold_verified; a case's own flags and values win.
    """
    own = lambda c: F.col(c) if c in cases.columns else None
    gold = F.coalesce("gold_verified", F.lit(False))
    plain, begin = F.col("case_id"), F.concat(pool["prefix"], F.lit("::"))
    prefixed = F.when((pool["prefix"] == "") | plain.startswith(begin), plain).otherwise(F.concat(begin, plain))
    flags = lifecycle_defaults(F.col("case_status"), gold, pool["gates"], own("release_gate_eligible"), own("human_review_required"))
    marks = {"dataset_pool_id": F.col("pool_id"), "dataset_role": pool["role"], "dataset_version": pool["version"], "source_hash": F.lit(source_hash), "is_public": pool["public"], "selection_seed": F.lit(seed), "profile_id": F.lit(profile)}
    out = cases.withColumns({"source_case_id": plain, "case_id": prefixed, "gold_verified": gold, **flags, **marks})
    out = out.withColumn("gate_eligible", pool["gates"] & F.col("release_gate_eligible"))
    return out.withColumns({k: F.coalesce(F.col(k), pool["defaults"][k]) if k in cases.columns else pool["defaults"][k] for k in defaults})


def _reach(cases: DataFrame, order: DataFrame, most: int, seed: str) -> DataFrame:
    """For each pool the cases that it may come to take, with their places by hash: slim rows (pool_order, case_id, place, quota).

    A pool passes over no more cases than earlier pools take in all, nor more than it shares with
    them, so its picks lie within that many places behind its quota. Places are taken in 32 parts of
    each pool first, cut at the longest reach, so that no task sorts a whole pool.
    """
    shared = cases.groupBy("case_id").agg(F.min("pool_order").alias("_first"))
    common = cases.join(shared, "case_id").groupBy("pool_order").agg(F.count_if(F.col("pool_order") > F.col("_first")).alias("_common"))
    depth = order.join(common, "pool_order").select("pool_order", "quota", (F.col("quota") + F.least("before", "_common")).alias("_depth"))
    hashed = cases.join(F.broadcast(depth), "pool_order").withColumn("_h", F.sha2(F.concat_ws(":", F.lit(seed), "pool_id", "case_id"), 256))
    parts = Window.partitionBy("pool_order", F.substring("_h", 64, 1), F.substring("_h", 63, 1) < "8").orderBy("_h", "case_id")
    first = hashed.withColumn("_n", F.row_number().over(parts)).where((F.col("_n") <= most) & (F.col("_n") <= F.col("_depth")))
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("pool_order").orderBy("_h", "case_id")))
    return placed.where(F.col("place") <= F.col("_depth")).select("pool_order", "case_id", "place", "quota")


def _claimed(reach: DataFrame) -> DataFrame:
    """(pool_order, case_id) of the cases that pools take, the earlier pool first.

    In each round every pool claims the first cases that it has not lost, as many as its quota; of the
    pools that claim a case the earliest holds it, and all later ones lose it. When no pool loses
    a case, each holds what it would have taken in its turn. The rounds follow chains of pools that
    take cases from each other, not the number of pools.
    """
    left = checkpointed(reach)
    while True:
        claims = left.withColumn("_n", F.row_number().over(Window.partitionBy("pool_order").orderBy("place"))).withColumn("_claims", F.col("_n") <= F.col("quota"))
        held = claims.where("_claims").groupBy("case_id").agg(F.min("pool_order").alias("_holder"), F.count("*").alias("_pools"))
        marked = checkpointed(claims.drop("_n").join(held, "case_id", "left"))
        lost = F.col("pool_order") > F.col("_holder")
        if marked.where(F.col("_claims") & lost).isEmpty():
            return marked.where("_claims").select("pool_order", "case_id")
        left = marked.where(~F.coalesce(lost, F.lit(False))).drop("_claims", "_holder", "_pools")


def composed(cases: DataFrame, pools: list[Pool], *, seed: str, profile: str = "", strict: bool = True) -> DataFrame:
    """An evaluation set from pools in order.

    ``cases`` has pool_id, case_id, ordinal, case_status and gold_verified. Of a pool's cases with one id
    the first counts; only active ones are taken, shadow ones where a pool has no active one (F3); a
    case that an earlier pool took is passed over, so later pools reach deeper. All pools are
    filled together, so neither plan nor jobs grow with their number; cases themselves never come to
    the driver. With ``strict`` a pool that falls short fails. Cases without an id are never taken.
    """
    spark, before, rows = cases.sparkSession, 0, []
    for k, p in enumerate(pools):
        rows.append((k, p.pool_id, p.quota, before, p.role, p.gates, p.prefix, p.version, p.public, dict(p.defaults)))
        before += p.quota
    order = spark.createDataFrame(rows, "pool_order int, pool_id string, quota int, before long, role string, gates boolean, prefix string, version string, public boolean, defaults map<string,string>")
    slim = cases.where("case_id is not null").groupBy("pool_id", "case_id").agg(F.min_by("case_status", F.struct("ordinal", "case_status")).alias("case_status"))
    wanted = slim.groupBy("pool_id").agg(F.when(F.bool_or(F.col("case_status") == "active"), "active").otherwise("shadow").alias("case_status"))
    able = slim.join(wanted, ["pool_id", "case_status"]).join(F.broadcast(order.select("pool_order", "pool_id")), "pool_id").select("pool_order", "pool_id", "case_id")
    taken = _claimed(_reach(able, order.select("pool_order", "quota", "before"), before, seed))
    if strict:
        have = {r["pool_order"]: r["count"] for r in taken.groupBy("pool_order").count().collect()}
        if short := {p.pool_id: p.quota for k, p in enumerate(pools) if have.get(k, 0) < p.quota}:
            raise ValueError(f"too few cases for {short}")
    names = [c for c in cases.columns if c not in ("pool_id", "case_id")]
    told = taken.join(F.broadcast(order), "pool_order")
    rest = cases.join(told.select("pool_id", "case_id").distinct(), ["pool_id", "case_id"], "left_semi").groupBy("pool_id", "case_id").agg(F.min_by(F.struct(*names), F.struct("ordinal", "case_status")).alias("_case"))
    both = rest.join(told.select("pool_id", "case_id", F.struct("role", "gates", "prefix", "version", "public", "defaults").alias("_pool")), ["pool_id", "case_id"])
    chosen = both.select("pool_id", "case_id", *[F.col("_case")[c].alias(c) for c in names], "_pool")
    return annotated(chosen, F.col("_pool"), sorted({k for p in pools for k in p.defaults}), seed, profile).drop("_pool")


def summary(chosen: DataFrame) -> DataFrame:
    """(figure, value, n): cases by pool, role, status and gate."""
    gate = F.when(F.col("gate_eligible"), "eligible").otherwise("not_eligible")
    each = F.array(*[F.struct(F.lit(n).alias("figure"), F.coalesce(c, F.lit("unknown")).alias("value")) for n, c in (("selected", F.col("dataset_pool_id")), ("role", F.col("dataset_role")), ("status", F.col("case_status")), ("gate", gate))])
    return chosen.select(F.explode(each).alias("e")).groupBy("e.figure", "e.value").agg(F.count("*").alias("n"))


def all_registered(pools: list[Pool], role: str) -> list[Pool]:
    """Every pool of a role, for a set of all registered cases."""
    return [p for p in pools if p.role == role]


def catalogue(found: DataFrame, listed: DataFrame) -> DataFrame:
    """Pools of a runtime catalogue: those listed, and discovered datasets that no entry has, marked as such."""
    new = found.join(listed.select("path").distinct(), "path", "left_anti").withColumn("discovered", F.lit(True))
    return listed.withColumn("discovered", F.lit(False)).unionByName(new, allowMissingColumns=True)


def runtime_pools(listed: DataFrame, found: DataFrame, sizes: DataFrame) -> DataFrame:
    """A row for each pool of the runtime catalogue: listed ones as they say, found ones by their role.

    ``listed`` has dataset_id, path, role and may have gate_eligible, registered, prefix and quota, ``found`` dataset_id,
    path and role; ``sizes`` has path and the rows that can be taken. What a listed pool leaves open is inherited: all its
    rows, else the quota it states, gating unless it is a benchmark, registered, its id as prefix. Found
    pools hold gold answers and active cases if they are for regression, else shadow ones.
    """
    both = catalogue(found.select("dataset_id", "path", "role"), listed)
    own = lambda c, kind: F.col(c) if c in both.columns else F.lit(None).cast(kind)
    out = both.join(sizes.groupBy("path").agg(F.max("rows").alias("_rows")), "path", "left")
    regression = F.col("role") == "regression"
    return out.select(
        "dataset_id", "path", "role", "discovered", F.coalesce(F.nullif(F.col("_rows"), F.lit(0)), own("quota", "long"), F.lit(0)).cast("long").alias("quota"),
        F.coalesce(own("gate_eligible", "boolean"), F.col("role") != "benchmark").alias("gate_eligible"), F.coalesce(own("registered", "boolean"), F.lit(True)).alias("registered"), F.coalesce(F.nullif(own("prefix", "string"), F.lit("")), "dataset_id").alias("prefix"),
        F.when(F.col("discovered"), F.when(regression, "active").otherwise("shadow")).alias("status_default"), F.when(F.col("discovered"), regression).alias("gold_default"),
    )


def role_defaults(pools: DataFrame, configured: dict[str, str], fallback: dict[str, str] | None = None) -> DataFrame:
    """(role, dataset_id, quota): the default pool of each role (T22): the configured one if it has that role, else the fallback, else the first by id that has rows."""
    chosen = lambda names: F.lit(False) if not names else F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("role")] == F.col("dataset_id"), F.lit(False))
    place = F.when(chosen(configured), 0).when(chosen(fallback or {}), 1).when(F.col("quota") > 0, 2)
    return pools.withColumn("_p", place).where("_p is not null").groupBy("role").agg(F.min_by(F.struct("dataset_id", "quota"), F.struct("_p", "dataset_id")).alias("_d")).select("role", "_d.*")


def profiles(pools: DataFrame, defaults: DataFrame) -> DataFrame:
    """(profile_id, role, dataset_id, quota): for each role the profile of its default pool and that of all registered ones (T22, U5); pools without rows are in none."""
    some = pools.where("quota > 0")
    one = defaults.where("quota > 0").select(F.concat(F.lit("default_"), "role").alias("profile_id"), "role", "dataset_id", "quota")
    return one.unionByName(some.where("registered").select(F.concat(F.lit("registered_"), "role", F.lit("_all")).alias("profile_id"), "role", "dataset_id", "quota"))


def profile_pools(pools: DataFrame, members: DataFrame, profile_id: str) -> list[Pool]:
    """The pools of a profile by id, as ``composed`` takes them; pools are few."""
    rows = members.where(F.col("profile_id") == profile_id).select("dataset_id", F.col("quota").alias("_quota")).join(pools, "dataset_id").orderBy("dataset_id").collect()
    return [Pool(r["dataset_id"], r["_quota"], role=r["role"], gate_eligible=r["gate_eligible"], prefix=r["prefix"]) for r in rows]


def first_source(sources: list[DataFrame]) -> DataFrame:
    """Cases of several sources in order of priority; of one id the first source counts."""
    out = sources[0].withColumn("_source", F.lit(0))
    for k, s in enumerate(sources[1:], 1):
        out = out.unionByName(s.withColumn("_source", F.lit(k)), allowMissingColumns=True)
    rest = [c for c in out.columns if c not in ("case_id", "_source")]
    return out.groupBy("case_id").agg(F.min_by(F.struct(*rest), "_source").alias("_r")).select("case_id", "_r.*")


def first_named(rows: DataFrame, key: str, name: str, order: Column) -> DataFrame:
    """The first name of each key that is not empty."""
    return rows.groupBy(key).agg(F.min_by(name, F.when(F.coalesce(F.trim(name), F.lit("")) != "", order)).alias(name))


def in_order(rows: DataFrame, configs: DataFrame, cases: DataFrame) -> DataFrame:
    """Rows by the positions of models, then cases, which they are given; unknown ones last, by name (W6). ``configs`` is a small list."""
    out = rows.join(F.broadcast(configs.select("config_id", F.col("position").alias("config_place"))), "config_id", "left").join(cases.select("case_id", F.col("position").alias("case_place")), "case_id", "left")
    return out.orderBy(F.col("config_place").asc_nulls_last(), "config_id", F.col("case_place").asc_nulls_last(), "case_id")


def sampled(cases: DataFrame, quotas: dict[str, int], seed: str, strict: bool = True) -> DataFrame:
    """Per pool the ``quota`` cases of least hash of seed, pool and id; the order of rows plays no part.

    Each pool takes its own top-n, so no pool is sorted whole in one task. With ``strict`` a
    pool that cannot fill its quota fails.
    """
    order = F.sha2(F.concat_ws(":", F.lit(seed), "pool_id", "case_id"), 256)
    if strict:
        have = {r["pool_id"]: r["count"] for r in cases.where(F.col("pool_id").isin(*quotas)).groupBy("pool_id").count().collect()}
        if short := {p: q for p, q in quotas.items() if have.get(p, 0) < q}:
            raise ValueError(f"too few cases for {short}")
    parts = [cases.where(F.col("pool_id") == p).withColumn("_order", order).orderBy("_order", "case_id").limit(q).drop("_order") for p, q in quotas.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def first_wins(cases: DataFrame) -> DataFrame:
    """Of cases with one id the first by pool order, then row order."""
    w = Window.partitionBy("case_id").orderBy("pool_order", "ordinal")
    return cases.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def allotted(pools: DataFrame, total: int) -> DataFrame:
    """Quotas in proportion to weights by largest remainder; pools that get none drop out."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy()) * total
    parts = pools.withColumn("_share", share).withColumn("_base", F.floor("_share").cast("long"))
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc(F.col("_share") - F.col("_base")), F.desc("weight"), "position"))
    out = parts.withColumn("quota", F.col("_base") + F.when(place <= left, 1).otherwise(0))
    return out.where("quota > 0").drop("_share", "_base")
