"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

The population is the words of the sources; a document is a block of them, and its size is
its number of words. Every source has an exact quota of words. Whole passes over the source
are taken first; what is left of the quota is divided among output shards by a splitting
tree over hash buckets that all sources share: a node's quota of a source is divided among its two
children by a hypergeometric draw given their sizes, so that the shards together have a
multivariate-hypergeometric share of it and their sum is the quota exactly. Inside a shard,
the blocks of each source are permuted by hash and drawn in that order until its quota is
filled; the last block is cut. No two shards share a block, a shard has no more than about
``LEAF_DOCS`` documents of a source however large it is, and no step gathers a source.
``mix`` brings the rows of each shard together, whatever their source, and shuffles them there.

All draws are functions of hashes of keys, so reruns agree. Only DataFrame functions are
used.

Defined cases: null text has size 0 and takes nothing; a null source is a source, the last;
a null id is an id; rows of equal id, source and text are blocks of their own: they are
numbered, so each has an order of its own and together they take what is due to the word;
a text of any length is one block; ties in size mean nothing; a source without words has target 0;
an empty table gives an empty result; other columns are ignored, or kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Weights of the sources in code point order, repeating; budget and cap as shares of sizes.
WEIGHTS, BUDGET, CAP = (3, 1, 2), 1.5, 2.0
#: Levels of the tree that one pass splits at most, and about how many documents a shard of an only source has at most.
LEVELS, LEAF_DOCS = 6, 1024
SEED = 42
#: Shards of some 60 bytes, by source, that may be broadcast.
BROADCAST_LEAVES = 500_000
#: Standard deviation from which a draw is made by rejection instead of by inversion; both are exact.
WIDE = 500.0
#: Tries of one draw by rejection: two of three succeed, so that all fail once in 10^30 draws; then the mode is drawn.
TRIES = 64


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from rows (source, size): one row a source.

    The budget is shared by weight; a source stops at its cap and the excess goes to the
    others by weight until none is above: with sources in the order of cap / weight, the
    first j are capped where j is the least for which the rest's share stays below the next
    cap. Sizes are summed before anything is ordered, so the windows see one row a source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    by = by.withColumn("weight", weight).withColumn("cap", CAP * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    by = by.withColumns(
        {
            "capped": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "light": F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
            "budget": BUDGET * F.sum("source_size").over(every),
            "heavy": F.sum("weight").over(every),
            "place": F.row_number().over(fill),
        }
    )
    level = (F.col("budget") - F.col("capped")) / (F.col("heavy") - F.col("light"))
    by = by.withColumn("level", level).withColumn("free", F.col("level") * F.col("weight") <= F.col("cap"))
    shared = F.min_by("level", F.when(F.col("free"), F.col("place"))).over(every)
    by = by.withColumn("share", F.coalesce(shared * F.col("weight"), F.col("cap")))
    return by.select("source", "source_size", F.least("share", "cap").alias("target"))


def _uniform(*keys: Column) -> Column:
    """In (0, 1), by hash."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *keys), 11).cast("double") + 0.5) / float(1 << 53)


def _ln_factorials(x: Column, y: Column) -> Column:
    """ln y! - ln x!, by the difference of Stirling's series, whose large terms cancel beforehand."""
    a, b = x + 1, y + 1
    return (a - 0.5) * F.log1p((y - x) / a) + (y - x) * F.ln(b) - (y - x) + (1 / b - 1 / a) / 12


def hypergeometric(rows: DataFrame, key: list[Column]) -> DataFrame:
    """Adds k: how many of ``quota`` items drawn from ``left + right`` fall to the left.

    By inversion of the distribution over twelve deviations around its mean, from the ratios
    of neighbouring chances; where the deviation passes ``WIDE``, by the ratio-of-uniforms
    rejection of Stadlober (1989), whose cost does not grow. Every step is a column of its
    own, so that no expression repeats another.
    """
    a, b, q, n = (F.col(c) for c in ("_a", "_b", "_q", "_n"))
    rows = rows.withColumns({"_a": F.col("left").cast("double"), "_b": F.col("right").cast("double"), "_q": F.col("quota").cast("double")})
    rows = rows.withColumns({"_n": a + b, "_low": F.greatest(F.lit(0.0), q - b), "_high": F.least(a, q)})
    rows = rows.withColumn("_mean", F.when(n > 0, q * a / n).otherwise(F.lit(0.0)))
    rows = rows.withColumn("_sd", F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("_mean") * (b / n) * ((n - q) / (n - 1))))).otherwise(F.lit(0.0)))
    reach = 12 * F.least("_sd", F.lit(WIDE)) + 6
    rows = rows.withColumns({"_k": F.greatest("_low", F.floor(F.col("_mean") - reach).cast("double")), "_end": F.least("_high", F.ceil(F.col("_mean") + reach).cast("double"))})
    steps = F.when((F.col("_end") > F.col("_k")) & (F.col("_sd") <= WIDE), F.sequence(F.lit(1), (F.col("_end") - F.col("_k")).cast("int"))).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("_steps", steps)
    first = F.struct(F.col("_k").alias("k"), F.lit(1.0).alias("p"), F.lit(1.0).alias("sum"))

    def step(s: Column) -> Column:
        p = s["p"] * (a - s["k"]) * (q - s["k"]) / ((s["k"] + 1) * (b - q + s["k"] + 1))
        return F.struct((s["k"] + 1).alias("k"), p.alias("p"), (s["sum"] + p).alias("sum"))

    rows = rows.withColumn("_u", _uniform(*key, F.lit("u")) * F.aggregate("_steps", first, lambda s, _: step(s), lambda s: s["sum"]))
    drawn = F.aggregate("_steps", first, lambda s, _: F.when(s["sum"] < F.col("_u"), step(s)).otherwise(s), lambda s: s["k"])
    # rejection draws from the smaller group and the smaller share, which are mirrored back
    g, m = F.col("_g"), F.col("_m")
    rows = rows.withColumns({"_g": F.least(a, b), "_m": F.least(q, n - q)})
    rows = rows.withColumns({"_mode": F.floor((m + 1) * (g + 1) / (n + 2)).cast("double"), "_centre": F.when(n > 0, m * g / n).otherwise(F.lit(0.0)) + 0.5, "_hat": 1.7155277699214135 * F.sqrt(F.col("_sd") * F.col("_sd") + 0.5) + 0.8989161620588988})

    def attempt(i: Column) -> Column:
        x, y = _uniform(*key, F.lit("x"), i), _uniform(*key, F.lit("y"), i)
        return F.struct(x.alias("x"), F.floor(F.col("_centre") + F.col("_hat") * (y - 0.5) / x).cast("double").alias("z"))

    def accepted(t: Column) -> Column:
        z, mode = t["z"], F.col("_mode")
        chance = -(_ln_factorials(mode, z) + _ln_factorials(g - mode, g - z) + _ln_factorials(m - mode, m - z) + _ln_factorials(n - g - m + mode, n - g - m + z))
        inside = (z >= F.greatest(F.lit(0.0), m + g - n)) & (z <= F.least(g, m))
        return F.when(inside, 2 * F.ln(t["x"]) <= chance).otherwise(False)

    tries = F.filter(F.transform(F.sequence(F.lit(1), F.lit(TRIES)), attempt), accepted)
    rows = rows.withColumn("_z", F.when(F.col("_sd") > WIDE, F.coalesce(F.get(tries, F.lit(0))["z"], F.col("_mode"))))
    rows = rows.withColumn("_z", F.when(a > b, m - F.col("_z")).otherwise(F.col("_z")))
    rows = rows.withColumn("_z", F.when(m < q, a - F.col("_z")).otherwise(F.col("_z")))
    rows = rows.withColumn("k", F.when(F.col("_sd") > WIDE, F.col("_z")).otherwise(drawn).cast("long"))
    return rows.drop("_a", "_b", "_q", "_n", "_low", "_high", "_mean", "_sd", "_k", "_end", "_u", "_steps", "_g", "_m", "_mode", "_centre", "_hat", "_z")


def _pairs(name: str, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(name, 2 * i) + F.get(name, 2 * i + 1))


def split(nodes: DataFrame, key: list[str], levels: int) -> DataFrame:
    """Rows (key, quota, sizes: array of 2^levels longs) to (key, child, quota), one a child.

    The sizes are the leaves of a binary heap; each level of it splits every row in two.
    """
    names = ["sizes"]
    for depth in range(levels):
        nodes = nodes.withColumn(f"_l{depth}", _pairs(names[-1], 1 << (levels - depth - 1)))
        names.append(f"_l{depth}")
    heap = F.concat(F.array(F.lit(0).cast("long")), *[F.col(x) for x in reversed(names)])
    rows = nodes.select(*key, "quota", heap.alias("_heap"), F.lit(1).alias("child"))
    for _ in range(levels):
        rows = rows.withColumns({"left": F.get("_heap", 2 * F.col("child")), "right": F.get("_heap", 2 * F.col("child") + 1)})
        rows = hypergeometric(rows, [*map(F.col, key), F.col("child")])
        both = F.array(F.struct((2 * F.col("child")).alias("child"), F.col("k").alias("quota")), F.struct((2 * F.col("child") + 1).alias("child"), (F.col("quota") - F.col("k")).alias("quota")))
        rows = rows.select(*key, "_heap", F.explode(both).alias("s")).select(*key, "_heap", "s.*")
    return rows.select(*key, (F.col("child") - (1 << levels)).alias("child"), "quota")


def _sized(docs: DataFrame) -> DataFrame:
    """Adds _size, and _id: a hash of the id, source and text."""
    null = F.concat(*[F.col(c).isNull().cast("string") for c in ("doc_id", "source", "text")])
    return docs.withColumns({"_size": F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long"), "_id": F.xxhash64(F.lit(SEED), null, "doc_id", "source", "text")})


def _numbered(rows: DataFrame) -> DataFrame:
    """(_row, _nth): the number of each of ``rows`` (_id, _row) among those of its _id.

    _row is a monotonically increasing id, so that its upper bits are a task's: rows are
    counted by task, then numbered inside a task's, and no task gathers all of an _id.
    """
    task = F.shiftright("_row", 33).alias("_task")
    rows = rows.select("_id", "_row", task)
    before = Window.partitionBy("_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_id", "_task").agg(F.count("*").alias("_n"))
    base = counts.select("_id", "_task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_id", "_task").orderBy("_row")) - 1
    return rows.withColumn("_inside", inside).join(base, ["_id", "_task"]).select("_row", (F.col("_base") + F.col("_inside")).alias("_nth"))


def _placed(rows: DataFrame) -> DataFrame:
    """Adds the key that places a block in the tree, and its order in a shard."""
    return rows.withColumn("_key", F.xxhash64(F.lit(SEED), "_id", "_nth")).withColumn("_o", F.xxhash64("_key", F.lit(SEED)))


def _repeated(rows: DataFrame) -> DataFrame | None:
    """The _id of rows that are there more than once, if any."""
    found = common.written(rows.groupBy("_id").agg(F.count("*").alias("n")).filter("n > 1").select("_id"), "mixture-repeated")
    return None if found.isEmpty() else found


def _with_numbers(rows: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """``rows`` (_id, _row) with _nth; only those that are repeated move."""
    if repeated is None:
        return rows.withColumn("_nth", F.lit(0).cast("long"))
    some = rows.join(repeated, "_id", "left_semi")
    some = some.join(_numbered(some), "_row")
    return rows.join(repeated, "_id", "left_anti").withColumn("_nth", F.lit(0).cast("long")).unionByName(some)


def _passes(n_docs: int) -> list[int]:
    """Levels of the tree that each pass splits: at least one, at most ``LEVELS``."""
    depth = max(1, (max(1, n_docs) // LEAF_DOCS).bit_length())
    return [min(LEVELS, depth - i) for i in range(0, depth, LEVELS)]


def _children(passes: list[int]) -> dict[str, Column]:
    """A pass takes as many bits of the key as it splits levels."""
    return {f"_c{p}": F.shiftrightunsigned("_key", sum(passes[:p])).bitwiseAND(F.lit((1 << levels) - 1)).cast("int") for p, levels in enumerate(passes)}


def leaves(docs: DataFrame) -> tuple[DataFrame, DataFrame, list[int], DataFrame | None]:
    """The blocks of ``docs`` (doc_id, source, text), the shards of the tree over them by source, its passes, and the repeated ids.

    A shard's row has its source's size, target and whole passes, and the cut: the order of
    the block at which its quota is filled, and how many of that block's words are taken.
    """
    sizes = _sized(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.col("_size").alias("size"), "_id", F.monotonically_increasing_id().alias("_row"))
    sizes = common.written(sizes, "mixture-sizes")
    repeated = _repeated(sizes)
    passes = _passes(sizes.count())
    blocks = _placed(_with_numbers(sizes, repeated)).withColumns(_children(passes)).drop("_id", "_row", "_nth", "_key")
    if repeated is not None:
        blocks = common.written(blocks, "mixture-blocks")
    goals = targets(sizes.select("source", "size")).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.greatest("source_size", F.lit(1)))).otherwise(0).cast("long"))
    goals = common.written(goals.withColumn("quota", F.round("target").cast("long") - F.col("whole") * F.col("source_size")), "mixture-goals")
    counts = common.written(blocks.groupBy("source", *[f"_c{p}" for p in range(len(passes))]).agg(F.sum("size").alias("words")), "mixture-counts")
    quotas = goals.select("source", "quota")
    for p, levels in enumerate(passes):
        key = ["source", *[f"_c{i}" for i in range(p)]]
        children = counts.groupBy(*key, f"_c{p}").agg(F.sum("words").alias("words"))
        nodes = children.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct(f"_c{p}", "words"))).alias("m"))  # 2^LEVELS at most
        nodes = nodes.withColumn("sizes", F.transform(F.sequence(F.lit(0), F.lit((1 << levels) - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))))
        nodes = _join(nodes.drop("m"), quotas, key)
        quotas = split(nodes, key, levels).withColumnRenamed("child", f"_c{p}")
    key = ["source", *[f"_c{p}" for p in range(len(passes))]]
    quotas = common.written(quotas, "mixture-quotas")
    rows = blocks.withColumn("_end", F.sum("size").over(Window.partitionBy(*key).orderBy("_o")))
    rows = _join(rows, quotas, key).filter(F.col("_end") >= F.col("quota"))
    found = rows.groupBy(*key).agg(F.min_by(F.struct("_o", "_end", "quota", "size"), "_o").alias("c"))
    found = found.select(*key, F.col("c._o").alias("cut"), (F.col("c.quota") - F.col("c._end") + F.col("c.size")).alias("part"))
    found = _join(found, goals.select("source", "source_size", "target", "whole"), ["source"])
    return blocks, common.written(found, "mixture-leaves"), passes, repeated


def _taken(rows: DataFrame, found: DataFrame, passes: list[int]) -> DataFrame:
    """Adds source_size, target, taken and shard to rows (source, _c0, ..., _o, size); no row moves while the shards can be broadcast."""
    if found.count() <= BROADCAST_LEAVES:
        found = F.broadcast(found)
    rows = _join(rows, found, ["source", *[f"_c{p}" for p in range(len(passes))]])
    drawn = F.when(F.col("_o") < F.col("cut"), F.col("size")).when(F.col("_o") == F.col("cut"), F.col("part")).otherwise(0)
    shard = F.lit(0).cast("long")
    for p, levels in enumerate(passes):
        shard = shard * (1 << levels) + F.col(f"_c{p}")
    return rows.withColumns({"taken": (F.col("whole") * F.col("size") + drawn).cast("long"), "shard": shard})


def _join(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Inner join in which null keys meet."""
    right = right.withColumnsRenamed({k: f"_r{k}" for k in key})
    return left.join(right, [left[k].eqNullSafe(right[f"_r{k}"]) for k in key]).drop(*[f"_r{k}" for k in key])


def plan(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, shard) of each row of ``docs`` (doc_id, source, text)."""
    blocks, found, passes, _ = leaves(docs)
    return _taken(blocks, found, passes).select("doc_id", "size", "source_size", "target", "taken", "shard")


def mix(docs: DataFrame) -> DataFrame:
    """The mixture itself, with the columns of ``docs``: each row as often as it is taken whole, then its first words.

    The rows of a shard, of all sources, are brought together and shuffled by hash. The
    words of a cut text are joined by single spaces; n_chars, if there, follows.
    """
    _, found, passes, repeated = leaves(docs)
    rows = _sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "doc_id", "source", "text"))
    rows = rows.select("doc", "source", F.col("_size").alias("size"), "_id")
    if repeated is None:
        rows = rows.withColumn("_nth", F.lit(0).cast("long"))
    else:
        some = rows.join(repeated, "_id", "left_semi").withColumn("_row", F.monotonically_increasing_id())
        some = common.written(some, "mixture-copies")  # so that a row keeps its number
        some = some.join(_numbered(some), "_row").drop("_row")
        rows = rows.join(repeated, "_id", "left_anti").withColumn("_nth", F.lit(0).cast("long")).unionByName(some)
    rows = _taken(_placed(rows).withColumns(_children(passes)), found, passes).filter("taken > 0 and size > 0")
    whole, rest = F.floor(F.col("taken") / F.col("size")).cast("int"), (F.col("taken") % F.col("size")).cast("int")
    each = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("doc", "shard", "_key", F.posexplode(each).alias("pass", "words"))
    rows = rows.withColumn("_place", F.xxhash64("_key", "pass", F.lit("order"))).drop("_key", "pass")
    rows = rows.repartition("shard").sortWithinPartitions("shard", "_place")
    cut = F.array_join(F.slice(common.words_of(F.col("doc.text")), 1, F.greatest("words", F.lit(0))), " ")
    rows = rows.withColumn("text", F.when(F.col("words") < 0, F.col("doc.text")).otherwise(cut))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("words") < 0, F.col("doc.n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
