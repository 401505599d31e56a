"""Class- and modality-balanced batch plans drawn from seeded hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchweave.functions.hashing import hash_uniform, hex_prefix, stable_hash
from benchweave.operators.metrics import inverse_frequency
from benchweave.operators.ranking import dense_index, row_numbers, running_total, top_rows
from benchweave.schemas import MODALITIES
from benchweave.session import cut_lineage, keep_table, small_side, spread

ENTITY_BLOCK = 4096
# Batches drawn by one task, and items of a pool that are put in order together.
BATCHES_AT_ONCE = 4096
POOL_BLOCK = 8192


def entity_weights(samples: DataFrame, power: float = 0.5) -> DataFrame:
    """Entities with their rows per modality and sampling weight 1 / n^power over all their rows."""
    counts = samples.groupBy("species").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("modality") == m).alias(m) for m in MODALITIES]
    )
    return counts.withColumn("weight", inverse_frequency("n", power))


def pool_order(samples: DataFrame, seed: int = 42, epoch: int = 0, cycle: int = 0) -> DataFrame:
    """Shuffled position of every item in its (species, modality) pool; hash buckets keep large pools split."""
    mark = stable_hash(seed + epoch, "species", "modality", F.lit(cycle), "id")
    ranked = row_numbers(samples.withColumn("_h", mark), ["species", "modality"], ["_h", "id"], "_p", bucket=hex_prefix(F.col("_h"), 3))
    return ranked.withColumn("pool_rank", F.col("_p") - 1).drop("_p", "_h")


def _intervals(entities: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """Each entity's share of [0, 1) per key, repeated for every slice of [0, 1) it touches.

    Weights are summed as whole units of the largest weight / 2^40, so neighbours touch exactly and the last ends at 1.
    """
    most = entities.groupBy(*keys).agg(F.max("weight").alias("_most"))
    units = F.greatest(F.lit(1), F.round(F.col("weight") / F.col("_most") * float(1 << 40)).cast("bigint"))
    whole = entities.join(most, keys).select(*keys, "species", units.alias("_units"))
    summed = running_total(whole, keys, ["species"], "_units", "_hi")
    totals = whole.groupBy(*keys).agg(F.sum("_units").alias("_sum"))
    joined = summed.join(totals, keys)
    low, high = (F.col("_hi") - F.col("_units")) / F.col("_sum"), F.col("_hi") / F.col("_sum")
    marked = joined.select(*keys, "species", low.alias("_lo"), high.alias("_up"))
    first, last = F.floor(F.col("_lo") * slices).cast("int"), F.least(F.floor(F.col("_up") * slices), F.lit(slices - 1)).cast("int")
    return marked.withColumn("_slice", F.explode(F.sequence(F.least(first, last), last)))


def _resolve(draws: DataFrame, intervals: DataFrame, keys: list[str], slices: int) -> DataFrame:
    """The entity each uniform ``u`` falls on: an equi-join on the slice, then an interval test.

    Draws come from ``explode``, whose rows the planner does not count, so they must never be taken for the small side:
    counted intervals are broadcast, and with too many of them both sides are shuffled. ``u`` is never null; unless the
    planner knows, it tests that before the join by hashing every draw twice more.
    """
    cut = draws.withColumn("u", F.coalesce("u", F.lit(0.0))).withColumn("_slice", F.least(F.floor(F.col("u") * slices), F.lit(slices - 1)).cast("int"))
    hits = cut.hint("merge").join(small_side(cut_lineage(intervals)), [*keys, "_slice"]).where((F.col("u") >= F.col("_lo")) & (F.col("u") < F.col("_up")))
    return hits.drop("_slice", "_lo", "_up")


def _slices(population: int) -> int:
    return 1 << max(6, min(20, (4 * population).bit_length()))


def pick_entities(batches: DataFrame, entities: DataFrame, k: int, seed: int = 42, tag: str = "pick") -> DataFrame:
    """``k`` distinct entities per batch, drawn by weight without replacement: (batch_id, species, place).

    Draws with replacement from the cumulative weights keep the first ``k`` distinct entities. A batch that saw fewer
    goes on with exponential keys ``-ln(u) / weight`` over the entities it has not seen: the same law, and one step
    however uneven the weights are.
    """
    pool = cut_lineage(entities.select("species", "weight"))
    population = pool.count()
    k = min(k, population)
    if k <= 0:
        return batches.sparkSession.createDataFrame([], "batch_id bigint, species string, place int")
    slices = _slices(population)
    intervals = _intervals(pool.withColumn("_all", F.lit(0)), ["_all"], slices)
    draws = batches.select("batch_id", F.explode(F.sequence(F.lit(0), F.lit(4 * k + 15))).alias("j")).withColumn("_all", F.lit(0))
    draws = draws.withColumn("u", hash_uniform(seed, F.lit(tag), "batch_id", "j"))
    seen = _resolve(draws, intervals, ["_all"], slices).groupBy("batch_id", "species").agg(F.min("j").alias("j"))
    picked = cut_lineage(top_rows(seen, ["batch_id"], ["j"], k, "place").select("batch_id", "species", "place"))
    short = picked.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_have")).where(F.col("_have") < k)
    if short.isEmpty():
        return picked
    return picked.unionByName(_rest(short, picked, pool, population, k, seed, tag))


def _rest(short: DataFrame, picked: DataFrame, pool: DataFrame, population: int, k: int, seed: int, tag: str) -> DataFrame:
    """What batches with only ``_have`` of ``k`` entities draw from those they have not ``picked``: (batch_id, species, place)."""
    blocks = -(-population // ENTITY_BLOCK)
    cut = pool.withColumn("_block", F.pmod(F.xxhash64("species"), F.lit(blocks)).cast("int"))
    open_pairs = short.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).hint("merge").join(small_side(cut), "_block")
    unseen = open_pairs.join(picked.select("batch_id", "species"), ["batch_id", "species"], "left_anti")
    keyed = unseen.withColumn("_key", -F.log1p(-hash_uniform(seed, F.lit(tag), F.lit("rest"), "batch_id", "species")) / F.col("weight"))
    ranked = top_rows(keyed, ["batch_id"], ["_key", "species"], k, "_r").withColumn("place", (F.col("_have") + F.col("_r")).cast("int"))
    return ranked.where(F.col("place") <= k).select("batch_id", "species", "place")


def _draw_batches(steps: int, entities: DataFrame, orders: dict[str, tuple[str, int]], slots: list[str], seed: int) -> DataFrame:
    """A row per batch: for every tag in ``orders`` the array of its distinct entities, and ``own``, the draw of each slot.

    ``orders`` names a tag's law (``entities`` holds law, species, weight) and how many entities it wants, as drawn by
    ``pick_entities``. All draws of a batch are made, resolved and gathered in the task that holds its number, so no draw
    is shuffled, and only the arrays are kept.
    """
    spark = entities.sparkSession
    codes = {law: i for i, law in enumerate(("pair", *MODALITIES))}  # two whole numbers make a join key of one long
    laws = cut_lineage(entities.withColumn("law", F.array_position(F.array(*[F.lit(law) for law in codes]), F.col("law")).cast("int") - 1))
    slices = _slices(laws.count())
    layout = [(t, law, j) for t, (law, k) in orders.items() for j in range(4 * k + 16)] + [("fill", m, s) for s, m in enumerate(slots)]
    one = lambda t, law, j: F.struct(F.lit(t).alias("tag"), F.lit(codes[law]).alias("law"), F.lit(j).alias("j"))
    batches = spark.range(0, steps, 1, max(spark.sparkContext.defaultParallelism, -(-steps // BATCHES_AT_ONCE)))
    draws = batches.select(F.col("id").alias("batch_id"), F.explode(F.array(*[one(*x) for x in layout])).alias("x")).select("batch_id", "x.*")
    named = _resolve(draws.withColumn("u", hash_uniform(seed, "tag", "batch_id", "j")), _intervals(laws, ["law"], slices), ["law"], slices)
    listed = lambda t: F.array_sort(F.collect_list(F.when(F.col("tag") == t, F.struct("j", "species")))).alias(t)
    per = named.groupBy("batch_id").agg(*[listed(t) for t in (*orders, "fill")])
    names = lambda t: F.transform(t, lambda x: x["species"])
    drawn = keep_table(per.select("batch_id", *[F.slice(F.array_distinct(names(t)), 1, k).alias(t) for t, (_, k) in orders.items()], names("fill").alias("own")))
    out = drawn
    for t, (law, k) in orders.items():
        short = drawn.where(F.size(t) < k)
        if not short.isEmpty():
            pool = laws.where(F.col("law") == codes[law]).select("species", "weight")
            rest = _rest(short.select("batch_id", F.size(t).alias("_have")), short.select("batch_id", F.explode(t).alias("species")), pool, pool.count(), k, seed, t)
            more = rest.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "species"))), lambda x: x["species"]).alias("_more"))
            out = out.join(small_side(cut_lineage(more)), "batch_id", "left").withColumn(t, F.concat(t, F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")
    return out


def fill_modalities(batch_size: int, pairs: int, target_macro: int) -> list[str]:
    """Modality of every slot left after the pairs: the modality further below its target, macro on ties."""
    have = {"macro": pairs, "micro": pairs}
    want = {"macro": target_macro, "micro": batch_size - target_macro}
    out = []
    for _ in range(batch_size - 2 * pairs):
        gap = {m: want[m] - have[m] for m in want}
        pick = "micro" if want["macro"] <= 0 else "macro" if want["micro"] <= 0 or gap["macro"] >= gap["micro"] else "micro"
        have[pick] += 1
        out.append(pick)
    return out


def _fold_fill(classes: int, pairs: int) -> Column:
    """Walk the fill slots of a batch: new entities while fewer than ``classes`` are present, then the slot's own draw.

    A fresh entity is the first of the modality's order without replacement that is not present yet. Fewer than
    ``classes`` are present then, so an order of ``classes`` entities holds one whenever the modality has one at all.
    Each of the first slots then adds one, so the walk mostly ends after ``classes - pairs`` slots.
    """
    start = F.struct(F.col("used").alias("used"), F.array().cast("array<string>").alias("picks"))

    def step(acc: Column, slot: Column) -> Column:
        order = F.when(slot["modality"] == "macro", F.col("fresh_macro")).otherwise(F.col("fresh_micro"))
        fresh = F.get(F.array_except(order, acc["used"]), F.lit(0))
        choice = F.when(F.size(acc["used"]) < classes, F.coalesce(fresh, slot["species"])).otherwise(slot["species"])
        return F.struct(F.array_union(acc["used"], F.array(choice)).alias("used"), F.concat(acc["picks"], F.array(choice)).alias("picks"))

    first = max(0, classes - pairs)
    own = F.transform(F.col("slots"), lambda x: x["species"])

    def end(acc: Column) -> Column:
        after = F.when(F.size("slots") > first, F.slice(own, first + 1, F.size("slots"))).otherwise(F.array().cast("array<string>"))
        whole = F.aggregate("slots", start, step, lambda done: done["picks"])
        return F.when(F.size(acc["used"]) >= classes, F.concat(acc["picks"], after)).otherwise(whole)

    return F.aggregate(F.slice("slots", 1, first), start, step, end)


def _blocks(items: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and ``_block``: the places ``_from`` to before ``_to`` that its items take in the key's hash order."""
    counts = items.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, 0)
    return cut_lineage(counts.withColumn("_to", F.sum("_n").over(upto)).withColumn("_from", F.col("_to") - F.col("_n")).drop("_n"))


def _block(mark: Column, size: Column) -> Column:
    """Block of a hash text in a key of ``size`` items: about POOL_BLOCK of them, and never against the hash order."""
    number = F.shiftright(hex_prefix(mark, 7).cast("bigint") * F.ceil(size / POOL_BLOCK), 28).cast("int")
    return F.coalesce(number, F.lit(0))  # never null, see ``_resolve``


def _locate(wanted: DataFrame, blocks: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` with the block that holds its ``_pos``: an equi-join on stretches of places, then an interval test."""
    stretch = lambda c: F.floor(c / POOL_BLOCK)
    touched = blocks.withColumn("_stretch", F.explode(F.sequence(stretch(F.col("_from")), stretch(F.col("_to") - 1))))
    hits = wanted.withColumn("_stretch", stretch(F.col("_pos"))).hint("merge").join(small_side(touched), [*keys, "_stretch"])
    hits = hits.where((F.col("_pos") >= F.col("_from")) & (F.col("_pos") < F.col("_to")))
    return hits.withColumn("_at", (F.col("_pos") - F.col("_from")).cast("int")).drop("_stretch", "_from", "_to", "_pos")


def _items_at(located: DataFrame, items: DataFrame, blocks: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``located`` rows with the ``fields`` of the item at ``_at`` in its block; items of other blocks are not moved.

    Either side is shuffled once, by block: the items of a block become one ordered list, which its rows look into.
    """
    place = [*keys, "_block"]
    inside = items.select(*place, "_mark", *fields).join(small_side(blocks.select(*place)), place, "left_semi")
    lists = inside.repartition(*place).groupBy(*place).agg(F.array_sort(F.collect_list(F.struct("_mark", *fields))).alias("_items"))
    found = located.hint("merge").join(lists, place).withColumn("_item", F.get("_items", F.col("_at")))
    return found.select(*[c for c in located.columns if c not in (*fields, "_at", "_block")], *[F.col("_item")[f].alias(f) for f in fields])


def _repeated(planned: DataFrame) -> DataFrame:
    """(batch_id, slot) of items that stand in an earlier slot of their batch too.

    Batch and id meet as one hash each, and whole rows are compared only where equal hashes were found.
    """
    marked = planned.withColumn("_both", F.xxhash64("batch_id", "id"))
    twice = marked.select("_both").repartition("_both").groupBy("_both").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_both")
    rows = marked.join(small_side(cut_lineage(twice)), "_both", "left_semi")
    first = Window.partitionBy("batch_id", "id").orderBy("slot", "species", "modality")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r > 1").select("batch_id", "slot")


def _top_up(plan: DataFrame, samples: DataFrame, steps: int, layout: list[str], pools: dict[str, int], salt: int) -> DataFrame:
    """Fill the slots that an item met twice leaves empty: same modality first, then the other one.

    Every short batch walks its modality's shuffled items from a place of its own. A walk of twice the batch size passes
    at least a batch of items that are not in it yet, so a batch stays short only when no items are left at all.
    ``plan`` is kept on shared storage and holds a slot at most once; ``layout`` is the modality of each slot.
    """
    size = len(layout)
    lost = cut_lineage(_repeated(plan))
    repeated = not lost.isEmpty()
    done = plan.join(small_side(lost), ["batch_id", "slot"], "left_anti").select(*plan.columns) if repeated else plan
    gaps = lost
    if plan.count() < steps * size:
        every = plan.sparkSession.range(steps).select(F.col("id").alias("batch_id"), F.explode(F.sequence(F.lit(0), F.lit(size - 1))).alias("slot"))
        gaps = cut_lineage(every.hint("merge").join(done.select("batch_id", "slot"), ["batch_id", "slot"], "left_anti"))
    elif not repeated:
        return done
    kind = F.get(F.array(*[F.lit(m) for m in layout]), F.col("slot"))
    needs = [F.count_if(kind == m).alias(f"_need_{m}") for m in MODALITIES]
    short = cut_lineage(gaps.groupBy("batch_id").agg(F.array_sort(F.collect_list("slot")).alias("_free"), *needs))
    walks = None
    for m, n in pools.items():
        if n:
            start = F.floor(hash_uniform(salt, F.lit("top_up"), F.lit(m), "batch_id") * n)
            walk = short.select("batch_id", F.lit(m).alias("modality"), F.explode(F.sequence(F.lit(0), F.lit(min(n, 2 * size) - 1))).alias("_step"), start.alias("_start"))
            walk = walk.select("batch_id", "modality", "_step", F.pmod(F.col("_start") + F.col("_step"), F.lit(n)).cast("bigint").alias("_pos"))
            walks = walk if walks is None else walks.unionByName(walk)
    if walks is None:
        return done
    mark = stable_hash(salt, F.lit("top_up"), "modality", "id")
    total = F.when(F.col("modality") == "macro", pools["macro"]).otherwise(pools["micro"])
    items = samples.where(F.col("modality").isin(*MODALITIES)).withColumns({"_mark": F.unhex(mark), "_block": _block(mark, total)})
    blocks = _blocks(items, ["modality"])
    located = _locate(walks, blocks, ["modality"])
    met = cut_lineage(located.select("modality", "_block").distinct())
    new = _items_at(located, items, met, ["modality"], ["id", "species"])
    held = done.select("batch_id", "id").join(small_side(short.select("batch_id")), "batch_id", "left_semi")
    new = new.join(held, ["batch_id", "id"], "left_anti")
    new = top_rows(new, ["batch_id", "modality"], ["_step"], size, "_r")
    found = new.groupBy("batch_id").agg(*[F.count_if(F.col("modality") == m).alias(f"_found_{m}") for m in MODALITIES])
    other = {"macro": "micro", "micro": "macro"}
    take = {m: F.least(F.col(f"_found_{m}"), F.col(f"_need_{m}") + F.greatest(F.lit(0), F.col(f"_need_{o}") - F.col(f"_found_{o}"))) for m, o in other.items()}
    ready = new.join(short.join(found, "batch_id").withColumns({f"_take_{m}": c for m, c in take.items()}), "batch_id")
    macro = F.col("modality") == "macro"
    chosen = ready.where(F.col("_r") <= F.when(macro, F.col("_take_macro")).otherwise(F.col("_take_micro")))
    place = F.col("_r") - 1 + F.when(macro, 0).otherwise(F.col("_take_macro"))
    return done.unionByName(chosen.select("batch_id", F.get("_free", place.cast("int")).alias("slot"), "id", "species", "modality"))


def plan_batches(
    samples: DataFrame,
    batch_size: int,
    classes: int | None = None,
    pairs: int | None = None,
    macro_fraction: float = 0.5,
    power: float = 0.5,
    seed: int = 42,
    epoch: int = 0,
    min_pairs: int = 1,
    drop_last: bool = False,
) -> DataFrame:
    """(epoch, batch_id, slot, id, species, modality) for one epoch over ``samples`` (id, species, modality).

    Every batch takes paired entities first (one macro and one micro item each), then fills towards the modality
    target. Items come from each pool in shuffled order; a pool that runs out is shuffled anew. An item never occurs
    twice in a batch: the slot of a repeated one is filled with another item of its modality, or else of the other one.
    Batches are short only where fewer items than slots exist; ``drop_last`` leaves those out.
    """
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")
    if not 0.0 <= macro_fraction <= 1.0:
        raise ValueError("macro_fraction must be between 0 and 1")
    samples = keep_table(samples.select("id", "species", "modality"))
    entities = cut_lineage(entity_weights(samples, power))
    paired = entities.where((F.col("macro") > 0) & (F.col("micro") > 0))
    sums = entities.agg(F.sum("macro"), F.sum("micro"), F.count(F.lit(1)), *[F.count_if(F.col(m) > 0) for m in MODALITIES]).first()
    n_macro, n_micro, n_entities, *held = (int(v or 0) for v in sums)
    total = n_macro + n_micro
    steps = total // batch_size if drop_last else -(-total // batch_size)
    n_paired = paired.count()
    half = batch_size // 2
    classes = classes or max(1, min(n_entities, half))
    wanted = min(pairs or max(min_pairs, batch_size // 4), half)
    k = max(min(n_paired, wanted), min(min_pairs, n_paired, half))
    fraction = macro_fraction if n_macro and n_micro else 1.0 if n_macro else 0.0
    slots = fill_modalities(batch_size, k, round(batch_size * fraction))
    salt = seed + epoch
    laws = paired.select(F.lit("pair").alias("law"), "species", "weight")
    for m in MODALITIES:
        laws = laws.unionByName(entities.where(F.col(m) > 0).select(F.lit(m).alias("law"), "species", "weight"))
    orders = {"pair": ("pair", k)} if k else {}
    orders |= {f"fresh_{m}": (m, min(classes, n)) for m, n in zip(MODALITIES, held) if n and k < classes and m in slots}
    drawn = _draw_batches(steps, laws, orders, slots, salt)
    none = F.array().cast("array<string>")
    ready = drawn.withColumns({t: none for t in ("pair", "fresh_macro", "fresh_micro") if t not in orders}).withColumn("used", F.col("pair"))
    kinds = F.array(*[F.lit(m) for m in slots]) if slots else none
    ready = ready.withColumn("slots", F.transform("own", lambda x, i: F.struct(F.get(kinds, i).alias("modality"), x.alias("species"))))
    both = F.flatten(F.transform("pair", lambda x: F.array(x, x)))
    named = keep_table(ready.select("batch_id", F.concat(both, _fold_fill(classes, k)).alias("names")))
    layout = [*MODALITIES] * k + slots
    picks = named.select("batch_id", F.posexplode("names").alias("slot", "species"))
    picks = picks.withColumn("modality", F.get(F.array(*[F.lit(m) for m in layout]), F.col("slot")))
    pool_key = ["species", "modality"]
    drawn_from = picks.groupBy(*pool_key).agg(F.count(F.lit(1)).alias("_draws"))
    pools = samples.groupBy(*pool_key).agg(F.count(F.lit(1)).alias("_size")).join(drawn_from, pool_key)
    pools = cut_lineage(dense_index(pools, pool_key, "_pool").withColumn("_pool", F.col("_pool").cast("int")))
    stride = max(1, -(-steps // spread(samples)))
    coded = picks.hint("merge").join(small_side(pools.select(*pool_key, "_pool", "_size")), pool_key).select("batch_id", "slot", "_pool", "_size")
    numbered = row_numbers(coded, ["_pool"], ["batch_id", "slot"], "_draw", bucket=F.floor(F.col("batch_id") / stride).cast("int"))
    draw = F.col("_draw") - 1
    placed = numbered.select("batch_id", "slot", "_pool", F.floor(draw / F.col("_size")).alias("_cycle"), F.pmod(draw, F.col("_size")).alias("_pos"))
    # Items once for every round of their pool; the last round only as far as it is drawn from.
    rounds = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_draws") - 1) / F.col("_size")))
    items = samples.join(small_side(pools), pool_key).withColumn("_cycle", F.explode(rounds))
    mark = stable_hash(salt, *pool_key, "_cycle", "id")
    items = items.withColumns({"_mark": F.unhex(mark), "_block": _block(mark, F.col("_size"))})
    keys = ["_pool", "_cycle"]
    blocks = _blocks(items, keys).join(small_side(pools.select("_pool", "_size", "_draws")), "_pool")
    blocks = cut_lineage(blocks.where(F.col("_from") < F.col("_draws") - F.col("_cycle") * F.col("_size")).drop("_size", "_draws"))
    planned = _items_at(_locate(placed, blocks, keys), items, blocks, keys, ["id"])
    planned = planned.join(small_side(pools.select("_pool", *pool_key)), "_pool")
    plan = keep_table(planned.select("batch_id", "slot", "id", *pool_key))
    plan = _top_up(plan, samples, steps, layout, {"macro": n_macro, "micro": n_micro}, salt)
    if drop_last:
        whole = plan.groupBy("batch_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == batch_size)
        plan = plan.join(whole.select("batch_id"), "batch_id", "left_semi")
    return plan.select(F.lit(epoch).alias("epoch"), "batch_id", "slot", "id", "species", "modality")


def audit_batches(plan: DataFrame) -> DataFrame:
    """Per batch: size, rows per modality, distinct entities, entities present in both modalities."""
    per = plan.groupBy("batch_id", "species").agg(*[F.count_if(F.col("modality") == m).alias(m) for m in MODALITIES])
    return per.groupBy("batch_id").agg(
        (F.sum("macro") + F.sum("micro")).alias("size"),
        F.sum("macro").alias("macro"),
        F.sum("micro").alias("micro"),
        F.count(F.lit(1)).alias("species"),
        F.count_if((F.col("macro") > 0) & (F.col("micro") > 0)).alias("paired_species"),
    )
