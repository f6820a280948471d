"""Parents, children and ancestors of units."""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmere.schemas import TABLE_TYPES
from quillmere.session import discard, scratch_path, store

#: Rows that are broadcast where their number is known.
BROADCAST_ROWS = 200_000


def parent_chains(units: DataFrame) -> DataFrame:
    """(id, depth, parents): names from the root to the parent, with a guard against cycles.

    Pointer doubling: each round puts behind a unit's known ancestors those of the last one, so a tree of depth d takes about log2(d)
    rounds, each stored, so that none is computed twice. A missing parent ends a chain, and so does one that is in
    it already.
    """
    named = units.select("id", "name", F.col("parent_unit_id").alias("up"))
    above = named.select(F.col("id").alias("up"), F.col("name").alias("up_name"))
    first = named.where(F.col("up") != F.col("id")).join(above, "up").select("id", F.array(F.struct(F.col("up").alias("id"), F.col("up_name").alias("name"))).alias("path"), F.col("up").alias("last"))
    now = store(units.select("id").join(first, "id", "left").select("id", F.coalesce("path", F.array().cast(first.schema["path"].dataType)).alias("path"), "last"), "chains")
    while now.where("last IS NOT NULL").limit(1).count():
        other = now.where(F.size("path") > 0).select(F.col("id").alias("last"), F.col("path").alias("more"), F.col("last").alias("next"))
        met = now.join(other, "last", "left")
        seen = F.concat(F.array("id"), F.transform("path", lambda x: x["id"]))
        # what comes after the first ancestor that is known already would go round
        again = F.transform(F.col("more"), lambda x: F.array_contains(seen, x["id"]))
        met = met.withColumn("place", F.coalesce(F.array_position(again, True), F.lit(0)))
        new = F.when(F.col("more").isNull(), F.slice("path", 1, 0)).when(F.col("place") > 0, F.slice("more", F.lit(1), F.col("place").cast("int") - 1)).otherwise(F.col("more"))
        goes_on = F.col("more").isNotNull() & (F.col("place") == 0)
        after = store(met.select("id", F.concat("path", new).alias("path"), F.when(goes_on, F.col("next")).alias("last")), "chains")
        discard(now)
        now = after
    names = F.reverse(F.filter(F.transform("path", lambda x: x["name"]), lambda x: x.isNotNull() & (x != "")))
    return now.select("id", F.size("path").alias("depth"), names.alias("parents"))


@dataclass
class Jumps:
    """Stored pointers to the parent, the parent's parent, the fourth, the eighth ... ancestor of every unit, in folders by step and bucket of the id."""

    spark: SparkSession
    path: str
    steps: int
    buckets: int = 16

    def step(self, k: int, buckets: list[int] | None = None) -> DataFrame:
        rows = self.spark.read.schema("id string, up string, step int, bucket int").parquet(f"{self.path}/jumps").where(F.col("step") == k)
        return (rows.where(F.col("bucket").isin(buckets)) if buckets is not None else rows).select("id", "up")

    def bucket(self, id_: str = "id"):
        return F.pmod(F.xxhash64(id_), F.lit(self.buckets)).cast("int")


def build_jumps(units: DataFrame, path: str | None = None, buckets: int = 16) -> Jumps:
    """Store the jumps of all ``units`` (id, parent_unit_id): as many rounds as the logarithm of the greatest depth.

    Missing parents and units that name themselves end a chain; rounds end with the logarithm of the number of units too, which ends cycles.
    """
    spark = units.sparkSession
    jumps = Jumps(spark, path or scratch_path(spark, "jumps"), 0, buckets)
    ids = units.select("id")
    edges = units.where(F.col("parent_unit_id") != F.col("id")).select("id", F.col("parent_unit_id").alias("up")).join(ids.withColumnRenamed("id", "up"), "up", "left_semi")
    most = max(1, math.ceil(math.log2(max(2, ids.count()))) + 1)

    def put(rows: DataFrame, k: int) -> None:
        rows.select("id", "up", jumps.bucket().alias("bucket")).repartition(buckets, "bucket").write.partitionBy("bucket").parquet(f"{jumps.path}/jumps/step={k}")

    put(edges, 0)
    while jumps.steps < most:
        now = jumps.step(jumps.steps)
        if not now.limit(1).count():
            break
        jumps.steps += 1
        put(now.join(now.select(F.col("id").alias("up"), F.col("up").alias("far")), "up").select("id", F.col("far").alias("up")), jumps.steps)
    return jumps


def ancestors_of(chosen: DataFrame, jumps: Jumps, n_chosen: int) -> DataFrame:
    """(id, up, distance): all ancestors of the ``chosen`` ids, a counted set, each once and by its shortest way.

    A round takes every ancestor that is known by another jump, twice as far as the round before: so depth d takes log2(d) rounds, and
    a round reads the buckets of the known ancestors only.
    """
    known = store(chosen.select("id").distinct().select("id", F.col("id").alias("up"), F.lit(0).alias("distance")), "ancestors")
    for k in range(jumps.steps + 1):
        from_ = known.withColumn("bucket", jumps.bucket("up"))
        read = [r.bucket for r in from_.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        small = n_chosen << k <= BROADCAST_ROWS
        start = from_.select("id", F.col("up").alias("at"), "distance")
        far = jumps.step(k, read).withColumnRenamed("id", "at").join(F.broadcast(start) if small else start, "at").select("id", "up", (F.col("distance") + (1 << k)).alias("distance"))
        both = known.unionByName(far).groupBy("id", "up").agg(F.min("distance").alias("distance"))
        after = store(both, "ancestors")
        grown = after.count() > known.count()
        discard(known)
        known = after
        if not grown:
            break
    return known.where("distance > 0")


def chains_of(chosen: DataFrame, units: DataFrame, jumps: Jumps, n_chosen: int) -> DataFrame:
    """(id, depth, parents) as :func:`parent_chains`, but of the ``chosen`` ids (a counted set) only, over stored jumps."""
    found = ancestors_of(chosen, jumps, n_chosen)
    named = units.select(F.col("id").alias("up"), "name").join(found, "up")
    rows = F.array_sort(F.collect_list(F.struct((-F.col("distance")).alias("d"), F.coalesce("name", F.lit("")).alias("name"))))
    one = named.groupBy("id").agg(F.count("*").cast("int").alias("depth"), F.filter(F.transform(rows, lambda r: r["name"]), lambda x: x != "").alias("parents"))
    return chosen.select("id").distinct().join(one, "id", "left").select("id", F.coalesce("depth", F.lit(0)).alias("depth"), F.coalesce("parents", F.array().cast("array<string>")).alias("parents"))


def parent_chains_sql(view: str) -> str:
    """The same as a recursive query over a view of units; ids on the way guard against cycles."""
    return f"""
    WITH RECURSIVE up(id, at, path, seen, depth) AS (
      SELECT id, parent_unit_id, cast(array() AS array<string>), array(id), 0 FROM {view}
      UNION ALL
      SELECT up.id, p.parent_unit_id, concat(array(p.name), up.path), concat(up.seen, array(p.id)), up.depth + 1
      FROM up JOIN {view} p ON up.at = p.id WHERE NOT array_contains(up.seen, p.id))
    SELECT id, max(depth) AS depth, max_by(path, depth) AS path FROM up GROUP BY id
    """


def recursive_chains(units: DataFrame) -> DataFrame:
    """(id, depth, path) by :func:`parent_chains_sql`, with no limit to rows and levels while it runs, as the ids on the way end it; the caller's settings stay."""
    spark = units.sparkSession
    view, limits = f"units_{uuid.uuid4().hex}", ("spark.sql.cteRecursionRowLimit", "spark.sql.cteRecursionLevelLimit")
    before = {k: spark.conf.get(k, None) for k in limits}
    store(units.select("id", "parent_unit_id", "name"), "edges").createOrReplaceTempView(view)  # each level reads it
    try:
        for k in limits:
            spark.conf.set(k, "-1")
        return store(spark.sql(parent_chains_sql(view)), "chains")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
        spark.catalog.dropTempView(view)


def expand(seeds: DataFrame, units: DataFrame, key: tuple[str, ...] = (), n_seeds: int | None = None) -> DataFrame:
    """(key, id, role, parent_unit_id, from_seeds) of the units that the seeds of table types bring along, seeds left out, each once.

    Every table type brings its parent; a row its siblings; a header, a list and a list item their children. ``key``
    names columns of ``seeds`` that tell questions apart. Seeds are broadcast only where the caller has counted them.
    """
    few = F.broadcast if n_seeds is not None and n_seeds <= 200_000 else (lambda df: df)
    s = few(seeds.where(F.col("type").isin(TABLE_TYPES)).select(*key, F.col("id").alias("s_id"), F.col("parent_unit_id").alias("s_parent"), F.col("type").alias("s_type")))
    u = units.select("id", F.col("parent_unit_id").alias("up"))
    named = lambda role, up: [*key, "id", F.lit(role).alias("role"), F.col(up).alias("parent_unit_id"), "s_id"]
    parent = u.join(s, s["s_parent"] == u["id"]).select(*named("parent", "s_parent"))
    sibling = u.join(s, (s["s_parent"] == u["up"]) & (s["s_type"] == "DataTableRow")).where("id <> s_id").select(*named("sibling", "s_parent"))
    child = u.join(s, (s["s_id"] == u["up"]) & (s["s_type"] != "DataTableRow")).select(*named("child", "s_id"))
    found = parent.unionByName(sibling).unionByName(child).join(few(seeds.select(*key, "id")), [*key, "id"], "left_anti")
    first = F.when(F.col("role") == "parent", 0).when(F.col("role") == "sibling", 1).otherwise(2)
    one = found.groupBy(*key, "id").agg(F.min_by(F.struct("role", "parent_unit_id"), F.struct(first, "parent_unit_id")).alias("x"), F.collect_set("s_id").alias("from_seeds"))
    return one.select(*key, "id", "x.role", "x.parent_unit_id", "from_seeds")


def asof_parent(units: DataFrame, scope: list[str], order: str) -> DataFrame:
    """``units`` with parent_id: the latest earlier unit of the same scope whose name is parent_name.

    A null parent_name, the unit's own name, or a name not met before gives null. A window carries each name's
    last unit forward, so there is one shuffle by (scope, name) and no pairs are formed.
    """
    from pyspark.sql.window import Window

    asked = units.select(*scope, F.col("parent_name").alias("key"), F.col(order).alias("at"), F.col("id").alias("who"), F.lit(1).alias("asks")).where("key IS NOT NULL")
    named = units.select(*scope, F.col("name").alias("key"), F.col(order).alias("at"), F.col("id").alias("who"), F.lit(0).alias("asks")).where("key IS NOT NULL AND key <> ''")
    w = Window.partitionBy(*scope, "key").orderBy("at", F.desc("asks")).rowsBetween(Window.unboundedPreceding, -1)
    found = named.unionByName(asked).withColumn("parent_id", F.last(F.when(F.col("asks") == 0, F.col("who")), ignorenulls=True).over(w)).where("asks = 1")
    found = found.select(F.col("who").alias("id"), "parent_id")
    own = F.col("parent_name") == F.col("name")
    return units.join(found, "id", "left").withColumn("parent_id", F.when(~F.coalesce(own, F.lit(False)), F.col("parent_id")))


def inherit_sections(units: DataFrame) -> DataFrame:
    """Units whose section is empty take that of the nearest ancestor that has one; a cycle of empty sections stays empty."""
    edges = units.select(F.col("id").alias("p_id"), F.col("section").alias("p_section"), F.col("parent_unit_id").alias("p_up"))
    now = store(units.select("id", "section", F.col("parent_unit_id").alias("up"), F.array("id").alias("seen")), "sections")
    open_ = (F.size("section") == 0) & F.col("up").isNotNull()
    while now.where(open_).limit(1).count():
        met = now.join(edges, (F.when(open_, F.col("up")) == F.col("p_id")) & ~F.array_contains("seen", F.col("p_id")), "left")
        on = F.col("p_id").isNotNull()
        after = met.select(
            "id", F.when(open_ & on, F.col("p_section")).otherwise(F.col("section")).alias("section"), F.when(on, F.col("p_up")).alias("up"),
            F.when(on, F.array_append("seen", F.col("p_id"))).otherwise(F.col("seen")).alias("seen"),
        )
        after = store(after, "sections")
        discard(now)
        now = after
    return units.drop("section").join(now.select("id", "section"), "id")


def containers(units: DataFrame, scope: str) -> DataFrame:
    """(scope, name, n_children): names that other units of the scope give as their parent's."""
    asked = units.where("parent_name IS NOT NULL").groupBy(scope, F.col("parent_name").alias("name")).agg(F.count("*").alias("n_children"))
    return asked.join(units.select(scope, "name"), [scope, "name"], "left_semi")


def tree(units: DataFrame) -> DataFrame:
    """(id, depth, children, n_below): each unit with its children in order; a unit that names itself, or a missing one, as parent is a root."""
    up = F.when(F.col("parent_unit_id") != F.col("id"), F.col("parent_unit_id"))
    u = units.withColumn("parent_unit_id", up)
    kids = u.where("parent_unit_id IS NOT NULL").groupBy(F.col("parent_unit_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("source_order", "id"))).alias("x"))
    named = u.select("id").join(kids, "id", "left").select("id", F.coalesce(F.transform("x", lambda r: r["id"]), F.array().cast("array<string>")).alias("children"))
    return named.join(parent_chains(u).select("id", "depth"), "id").withColumn("n_below", F.size("children").cast("long"))
