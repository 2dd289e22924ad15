"""Inventory state: menus, slots, levels and rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sessionlake.operators.folds import session_fold
from sessionlake.operators.ordering import TimeOrder, last_seen, running_max, running_sum, time_order
from sessionlake.operators.release import renumbered
from sessionlake.operators.timejoin import asof, nearest, stream_join
from sessionlake.session import cut_lineage


def level_up_transactions(menus: DataFrame, changes: DataFrame, *, key: str = "session_id", tolerance_ms: int = 250,
                          continuation_ms: int = 250, cursor_minimum: float = 20.0) -> DataFrame:
    """One transaction per menu: a selected reward, a banished maximum-level item, or unresolved.

    A menu without its own change continues the one before it when that one (or the chain it continues) selected the
    same item.  A chain is a stretch of possible continuations, so its fate is that of the row it starts from.
    ``menus``: ``start_ms, end_ms, candidate, option_count, cursor_score, needs_review, event_id``;
    ``changes``: ``t_ms, event_id, item, level, max_level``.
    """
    m = menus.filter(F.col("cursor_score") >= cursor_minimum)
    hits = changes.select(key, "t_ms", F.col("event_id").alias("change_id"), "item")
    m = nearest(m, hits, ["change_id", "item"], tolerance_ms, keys=[key], left_time="end_ms", right_time="t_ms", right_tie="change_id", distance="_gap")
    owned = changes.select(key, "t_ms", F.col("item").alias("candidate"), "level", "max_level", "event_id")
    m = asof(m, owned, ["level", "max_level"], prefix="owned_", strict=True, keys=[key, "candidate"], left_time="end_ms", right_tie="level")
    order = time_order(m, key, ("end_ms", "event_id"))
    matched = F.col("change_id").isNotNull()
    d = m.withColumn("_name", F.when(matched, F.col("item")).otherwise(F.col("candidate")))
    d = order.frames(order.tag(d), 1, _pn=lambda w: F.lag("_name").over(w), _pc=lambda w: F.lag("option_count").over(w), _pe=lambda w: F.lag("end_ms").over(w))
    gap = F.col("start_ms") - F.col("_pe")
    may = F.coalesce(~matched & (F.col("_pn") == F.col("candidate")) & (F.col("_pc") == F.col("option_count")) & gap.between(0, continuation_ms), F.lit(False))
    d = d.withColumn("_may", may)
    d = order.running(d, _base=last_seen(F.when(~F.col("_may"), F.struct(matched.alias("ok"), F.col("event_id").alias("id")))))
    joins = F.col("_may") & F.col("_base.ok")
    d = order.untag(d.withColumn("_owner", F.when(joins, F.col("_base.id")).otherwise(F.col("event_id"))))
    at_max = (F.col("option_count") == 1) & (F.col("owned_level") >= F.col("owned_max_level"))
    action = F.when(matched, "select_reward").when(F.coalesce(at_max, F.lit(False)), "banish").otherwise("unresolved_no_inventory_transition")
    grade = (F.when(matched, F.when(F.col("needs_review"), "C").otherwise("A")).when(F.coalesce(at_max, F.lit(False)), "B").otherwise("unresolved"))
    own = F.col("_owner") == F.col("event_id")
    first = F.max(F.when(own, F.struct(action.alias("action"), grade.alias("grade"), F.col("item").alias("item"), F.col("start_ms").alias("start"), F.col("change_id").alias("change_id"))))
    return d.groupBy(key, F.col("_owner").alias("event_id")).agg(first.alias("_f"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("menu_records")).select(
        key, "event_id", F.col("_f.start").alias("start_ms"), "end_ms", F.col("_f.action").alias("action"), F.col("_f.grade").alias("evidence_grade"),
        F.col("_f.item").alias("item_name"), F.col("_f.change_id").alias("change_id"), "menu_records")


def instant_rewards(transactions: DataFrame, labels: str, selected: str, pair: tuple[str, str]) -> DataFrame:
    """Two-choice menus whose labels are exactly ``pair``: the resolved transaction and the reward outcome."""
    two = F.size(labels) == 2
    exact = two & (F.size(F.array_except(labels, F.array(*map(F.lit, pair)))) == 0) & (F.size(F.array_distinct(labels)) == 2)
    reward = F.get(labels, F.col(selected))
    d = transactions.filter(exact & (F.col(selected) < 2)).withColumn("reward", reward)
    kind = F.when(F.col("reward") == pair[0], "big_coin_bag").otherwise("floor_chicken")
    family = F.when(F.col("reward") == pair[0], "currency").otherwise("consumable")
    rows = F.explode(F.array(
        F.struct(F.lit("level_up_transaction").alias("event_type"), F.lit("menu_action").alias("event_family"), F.lit("select_instant_reward").alias("action")),
        F.struct(kind.alias("event_type"), family.alias("event_family"), F.lit("acquired").alias("action")))).alias("e")
    return d.select(*transactions.columns, "reward", rows).select(*transactions.columns, "reward", "e.*")


def snapshot_increase(snapshots: DataFrame, order: TimeOrder, levels: str, *, confirm: bool = False) -> DataFrame:
    """Slots that rose by exactly one between consecutive snapshots, when it is the only one.

    ``levels`` maps slot to level.  With ``confirm`` the snapshot after must still show the new level.
    """
    d = order.frames(order.tag(snapshots), 2, _after=lambda w: F.lead(levels).over(w), _later=lambda w: F.lead(levels, 2).over(w))
    d = order.untag(d)
    grown = F.filter(F.map_keys("_after"), lambda s: F.coalesce(F.element_at("_after", s) == F.element_at(levels, s) + 1, F.lit(False)))
    d = d.withColumn("_grown", grown).filter(F.size("_grown") == 1).withColumn("slot", F.get("_grown", F.lit(0)))
    before = F.element_at(levels, F.col("slot"))
    if confirm:
        d = d.filter(F.element_at("_later", F.col("slot")) >= before + 1)
    return d.select(*order.keys, *order.by, "slot", before.alias("level_before"), (before + 1).alias("level_after"))


def stabilised_slots(long: DataFrame, order: TimeOrder, *, name: str, suggestion: str, confidence: str, lookahead: int = 3,
                     support: int = 2) -> DataFrame:
    """Slot readings that persist; a reading counts when it appears ``support`` times in the next ``lookahead`` samples.

    Accepting the current name again never changes it, so the current name is the last supported one, and the carried
    metrics are those of the last accepted row.
    """
    d = order.frames(order.tag(long), lookahead, _ahead=lambda w: F.collect_list(name).over(w.rowsBetween(0, lookahead - 1)))
    one = F.lit(1).cast("long")
    from sessionlake.operators.ordering import Running

    d = order.running(d, _n=running_sum(one), _left=Running("sum", one, exclusive=True, reverse=True))
    here = F.col(name)
    named = here != ""
    alone = (F.col("_n") == 1) & F.col("_left").isNull() & (F.col(confidence) == "high")
    backed = named & ((F.size(F.filter("_ahead", lambda x: x == here)) >= support) | alone)
    d = order.running(d.withColumn("_backed", F.when(backed, here)), _current=last_seen(F.col("_backed")))
    accepted = F.coalesce(named & (here == F.col("_current")), F.lit(False))
    d = d.withColumn("_accepted", accepted)
    row = F.struct(F.when(F.col(suggestion) != "", F.col(suggestion)).otherwise(here).alias("s"), F.col(confidence).alias("c"))
    d = order.untag(order.running(d.withColumn("_row", F.when(F.col("_accepted"), row)), _kept=last_seen(F.col("_row"))))
    return d.select(*order.keys, *order.by, here.alias("raw_weapon"), F.coalesce("_current", F.lit("")).alias("weapon"),
                    F.coalesce("_kept.s", F.lit("")).alias("suggested_weapon"), F.coalesce("_kept.c", F.lit("empty")).alias("confidence"),
                    (F.col("_current").isNotNull() & ~F.col("_accepted")).alias("carried"))


def slot_changes(long: DataFrame, order: TimeOrder, weapon: str) -> DataFrame:
    """Changes of each slot: initial, acquired, removed, or changed."""
    d = order.frames(order.tag(long), 1, _was=lambda w: F.lag(weapon).over(w))
    d = order.untag(d)
    old = F.coalesce("_was", F.lit(""))
    kind = (F.when((old == "") & (F.col(weapon) != ""), F.when(F.col("_was").isNull(), "initial").otherwise("acquired"))
            .when((old != "") & (F.col(weapon) == ""), "removed").otherwise("changed_or_evolved"))
    return d.filter(F.col(weapon) != old).select(*order.keys, *order.by, kind.alias("event"), old.alias("previous_weapon"), F.col(weapon).alias("weapon"))


def replacements(timeline: DataFrame, order: TimeOrder, names: str, evolved_from: dict[str, str]) -> DataFrame:
    """Known evolutions: the evolved name appears in the sample in which its base disappears; the first time counts."""
    d = order.untag(order.frames(order.tag(timeline), 1, _was=lambda w: F.lag(names).over(w)))
    table = F.create_map(*[F.lit(x) for pair in evolved_from.items() for x in pair])
    added, removed = F.array_except(names, "_was"), F.array_except("_was", names)
    d = d.withColumn("_removed", removed).withColumn("item_after", F.explode(added))
    d = d.withColumn("item_before", F.element_at(table, F.col("item_after"))).filter(F.array_contains("_removed", F.col("item_before")))
    first = F.min_by(F.struct(*order.by, "item_before", F.array_position(names, F.col("item_after")).alias("slot")), F.struct(*order.by))
    return d.groupBy(*order.keys, "item_after").agg(first.alias("_f")).select(*order.keys, "item_after", "_f.*")


def _retirements(evolutions: DataFrame, order: TimeOrder) -> DataFrame:
    """(keys, item, retired_at): when each item first gave way to an evolution.

    A retrospective row of an item that has gone is contradicted, and this can be an evolution itself, so evolutions alone are folded: a
    session has as many as its items have forms. Their own number decides whether they are cut, not that of all events."""
    keys, by = list(order.keys), order.by[:2]

    def step(gone, row):
        t, tie, before, after, retro = row
        gone = gone or []
        if (retro and after in gone) or before is None or before in gone:
            return gone, []
        return [*gone, before], [(before, t, tie)]

    own = time_order(evolutions, keys, by) if order.split else TimeOrder(tuple(keys), by)
    found = session_fold(evolutions, own, [*by, "before", "after", "retro"], step, f"item string, {by[0]} long, {by[1]} long")
    return found.select(*keys, "item", F.struct(*by).alias("retired_at"))


def _owned_before(touches: DataFrame, order: TimeOrder) -> DataFrame:
    """touches with `held`, how often the item stood in its list just before the row.

    A gain makes that one at least, an evolution into the item adds one if its base was held (else one at least), an evolution of it takes one away:
    every step is max(n + add, least), so a running sum and a running maximum give all of them."""
    add = F.when(F.col("role") == 0, -1).when(F.col("swaps"), 1).otherwise(0).cast("long")
    least = F.when(F.col("role") == 0, 0).otherwise(1).cast("long")
    d = order.running(order.tag(touches.withColumns({"_add": add, "_least": least})), _sum=running_sum(F.col("_add")))
    d = order.untag(order.running(d, _top=running_max(F.col("_least") - F.col("_sum"), exclusive=True)))
    held = F.col("_sum") - F.col("_add") + F.greatest(F.lit(0), F.coalesce("_top", F.lit(0)))
    return d.withColumn("held", held).drop("_add", "_least", "_sum", "_top")


def progression(events: DataFrame, order: TimeOrder, maxima: dict[str, int] | None = None, prefix: str = "inventory_event") -> DataFrame:
    """Levels recomputed in time order over all sources, with evolutions that retire their base item.

    ``events``: ``item_type, change, source, item_before, item_after, configured_level``. Nothing is folded: every event becomes a row of each item it
    touches, and an item's levels are counts since it was last gained, evolved or lost, windows over its own rows. So the number of passes does not
    depend on how a session is cut. Contradicted retrospective rows are dropped, rows are numbered, and levels above the item's normal maximum are flagged.
    """
    keys, (time, tie) = list(order.keys), order.by[:2]
    name = lambda c: F.nullif(F.trim(F.coalesce(F.col(c), F.lit(""))), F.lit(""))
    place = F.struct(F.col(time), F.col(tie))
    rows = events.select(*keys, time, tie, "item_type", "change", name("item_before").alias("before"), name("item_after").alias("after"), "configured_level",
                         F.coalesce(F.col("source") == "level_up_retrospective", F.lit(False)).alias("retro"), place.alias("place")).filter("after IS NOT NULL")
    gone = _retirements(rows.filter("change = 'evolution'").select(*keys, time, tie, "before", "after", "retro"), order)
    rows = rows.join(gone.withColumnRenamed("item", "after"), [*keys, "after"], "left").filter(F.coalesce(~(F.col("retro") & (F.col("retired_at") < F.col("place"))), F.lit(True)))
    evolves = F.col("change") == "evolution"
    enters = F.struct(F.lit(1).alias("role"), F.col("after").alias("item"))
    leaves = F.struct(F.lit(0).alias("role"), F.col("before").alias("item"))
    roles = F.when(evolves & F.col("before").isNotNull(), F.array(leaves, enters)).otherwise(F.array(enters))
    touches = rows.withColumn("_t", F.explode(roles)).select(*rows.columns, "_t.*").withColumn("turn", F.col(tie) * 2 + F.col("role")).drop("place", "retired_at", "retro")
    touches = touches.withColumn("swaps", evolves & F.col("before").isNotNull())
    by_item = time_order(touches, (*keys, "item"), (time, "turn"))
    listed = (*keys, "item_type", "item")
    by_list = time_order(touches, listed, (time, "turn")) if by_item.split else TimeOrder(listed, (time, "turn"))  # no list of an item has more rows than the item
    while True:  # whether an evolution's base was held is first taken for granted; it matters only where the evolved item was held already
        held = cut_lineage(_owned_before(touches, by_list))
        found = held.filter("role = 0").select(*keys, tie, (F.col("held") > 0).alias("_held"))
        again = held.filter("role = 1").join(found, [*keys, tie], "left").withColumn("_swaps", F.coalesce("_held", F.lit(False)))
        if again.filter("_swaps <> swaps AND held > 0").isEmpty():
            break
        touches = again.withColumn("swaps", F.col("_swaps")).select(touches.columns).unionByName(held.filter("role = 0").select(touches.columns))
    first = F.when((F.col("change") == "initial_state") & F.col("configured_level").isNotNull(), F.greatest(F.lit(1), F.col("configured_level"))).otherwise(1).cast("long")
    gains = (F.col("role") == 1) & ~evolves
    rises = gains & (F.col("held") > 0)
    start = F.when(F.col("role") == 0, F.lit(None).cast("long")).when(evolves, F.lit(1).cast("long")).otherwise(first)
    d = by_item.running(by_item.tag(held.withColumns({"_rises": rises, "_start": start})), _n=running_sum(F.col("_rises").cast("long")))
    mark = F.when(~F.col("_rises"), F.struct(F.col("_start").alias("level"), F.col("_n").alias("n")))
    d = by_item.untag(by_item.running(d.withColumn("_mark", mark), _since=last_seen(F.col("_mark")), _until=last_seen(F.col("_mark"), exclusive=True)))
    level = F.coalesce("_since.level", F.lit(1)) + F.col("_n") - F.coalesce("_since.n", F.lit(0))
    more = F.col("_n") - F.coalesce("_until.n", F.lit(0))
    lost = F.coalesce(F.col("_until.level"), F.when(more > 0, 1)) + more
    d = d.withColumns({"_level": level, "_lost": lost})
    bases = d.filter("role = 0").select(*keys, tie, F.col("_lost").alias("_base"))
    d = d.filter("role = 1").join(bases, [*keys, tie], "left")
    kind = F.when(evolves, "evolution").when(F.col("_rises"), "upgrade").when(F.col("change") == "initial_state", "initial_state").otherwise("new")
    limit = F.element_at(F.create_map(*(F.lit(x) for pair in maxima.items() for x in pair)), F.col("after")) if maxima else F.lit(None)
    out = d.select(*keys, time, tie, kind.alias("event_type"), F.when(evolves, F.col("before")).when(F.col("_rises"), F.col("after")).alias("item_before"), F.col("after").alias("item_after"),
                   F.when(evolves, F.col("_base")).when(F.col("_rises"), F.col("_level") - 1).alias("level_before"), F.col("_level").alias("level_after"), limit.cast("long").alias("normal_max_level"))
    out = out.withColumn("needs_review", F.coalesce(F.col("level_after") > F.col("normal_max_level"), F.lit(False)))
    return renumbered(out, order, prefix, "row_id").drop(time)


def _grown_slots(before: Column, after: Column) -> Column:
    """(place, level) of every place whose level rose by exactly one between two snapshots (map of `type:slot` to level)."""
    rose = F.filter(F.map_keys(after), lambda p: F.coalesce(F.element_at(after, p) == F.element_at(before, p) + 1, F.lit(False)))
    return F.transform(rose, lambda p: F.struct(p.alias("place"), F.element_at(after, p).alias("level")))


def _acquired(rows: DataFrame, opening: DataFrame, keys: list[str], slots: int) -> DataFrame:
    """(keys, item_type, item, at, slot): when each item joined its list, and where it stands there; `at` is null for the opening inventory.

    While a list has room, an item joins with its first usable choice; after that only with a choice that needs no review. So the first items to
    appear fill the list, and the others wait for their first sure choice: two minima per item, and ranks over items, not over rows."""
    listed = [*keys, "item_type"]
    usable = (F.col("cursor_score") >= 20) & ~F.col("fired")
    seen = rows.groupBy(*listed, "item").agg(F.min(F.when(usable, F.col("place"))).alias("first"), F.min(F.when(usable & ~F.col("needs_review"), F.col("place"))).alias("sure"))
    taken = opening.groupBy(*listed).agg(F.count(F.lit(1)).alias("taken"))
    fresh = seen.filter("first IS NOT NULL").join(opening, [*listed, "item"], "left_anti").join(taken, listed, "left").fillna(0, ["taken"])
    by_first, by_time = Window.partitionBy(*listed).orderBy("first"), Window.partitionBy(*listed).orderBy("at")
    fresh = fresh.withColumn("at", F.when(F.row_number().over(by_first) <= slots - F.col("taken"), F.col("first")).otherwise(F.col("sure"))).filter("at IS NOT NULL")
    joined = fresh.select(*listed, "item", "at", (F.col("taken") + F.row_number().over(by_time)).cast("long").alias("slot"))
    return joined.unionByName(opening.select(*listed, "item", F.lit(None).cast(joined.schema["at"].dataType).alias("at"), F.col("slot").cast("long").alias("slot")))


def inventory_build(selections: DataFrame, order: TimeOrder, opening: DataFrame | None = None, *, slots: int = 6) -> DataFrame:
    """Inventory rows from menu choices: the opening inventory, then upgrades and new items; impossible choices are excluded with a reason.

    ``selections``: ``item_type, item, cursor_score, needs_review, max_level`` (one per item) ``, snapshot`` (map of `type:slot` to level, may be null);
    ``opening``: ``item_type, slot, item, baseline_ms``, slots from 1 without gaps. Menus up to a session's baseline are cut before anything looks ahead.

    A doubtful choice of an owned item is confirmed, and a doubtful choice of anything replaced, by the only level that rose in the next snapshot
    (`level_up_retrospective`). What replaced a choice decides which items are owned later, and that decides which levels count, so replacements are settled in
    rounds; only earlier rows decide, and a round is a few windows and joins whatever the number of pieces. An item is of one type.
    """
    keys, (time, tie) = list(order.keys), order.by[:2]
    rows = selections
    if opening is None:
        opening = rows.limit(0).select(*keys, "item_type", F.lit(1).alias("slot"), "item", F.lit(0).cast("long").alias("baseline_ms"))
    starts = opening.groupBy(*keys).agg(F.min("baseline_ms").alias("_baseline"))
    rows = rows.join(starts, keys, "left").filter(F.coalesce(F.col(time) > F.col("_baseline"), F.lit(True))).drop("_baseline")
    ahead = order.untag(order.frames(order.tag(rows), 2, _next=lambda w: F.lead("snapshot").over(w), _later=lambda w: F.lead("snapshot", 2).over(w)))
    rows = cut_lineage(ahead.select(*keys, time, tie, "item_type", "item", "cursor_score", "needs_review", "max_level", F.struct(time, tie).alias("place"),
                                    F.when(F.col("needs_review"), _grown_slots(F.col("snapshot"), F.col("_next"))).alias("grown"), F.col("_later").alias("later"),
                                    F.lit(False).alias("fired"), F.lit(None).cast("string").alias("to_type"), F.lit(None).cast("string").alias("to_item"), F.lit(None).cast("long").alias("to_slot")))
    listed = [*keys, "item_type"]
    per_item = time_order(rows, (*listed, "item"), (time, tie))
    while True:
        owned = _acquired(rows, opening, keys, slots)
        before = lambda at: F.coalesce(F.col(at) < F.col("place"), F.lit(True))
        d = rows.join(owned, [*listed, "item"], "left").join(owned.filter(F.col("slot") == slots).select(*listed, F.col("at").alias("_full"), F.lit(True).alias("_has_full")), listed, "left")
        d = d.withColumns({"has": F.col("slot").isNotNull() & before("at"), "joins": F.coalesce(F.col("at") == F.col("place"), F.lit(False)), "full": F.coalesce(F.col("_has_full"), F.lit(False)) & before("_full")})
        own = F.filter("grown", lambda g: F.substring_index(g["place"], ":", 1) == F.col("item_type"))
        there = (F.col("slot") > slots) | (F.substring_index(F.get(own, F.lit(0))["place"], ":", -1).cast("long") == F.col("slot"))
        d = d.withColumn("confirmed", F.coalesce(F.col("has") & (F.size(own) == 1) & there, F.lit(False)) & ~F.col("joins"))
        moves = F.col("fired") | F.col("confirmed") | ((F.col("cursor_score") >= 20) & F.col("has"))
        d = d.withColumns({"moves": moves, "sure": F.col("fired") | F.col("confirmed"), "on_type": F.coalesce("to_type", "item_type"), "on_item": F.coalesce("to_item", "item")})
        steps = d.select(*keys, time, tie, F.col("on_type").alias("item_type"), F.col("on_item").alias("item"), "moves", "sure", F.lit(False).alias("asks"))
        # whether a replaced choice was at its maximum depends on its own item, not on the one that replaced it
        replaced = d.filter(F.col("fired") & ((F.col("to_type") != F.col("item_type")) | (F.col("to_item") != F.col("item"))))
        steps = steps.unionByName(replaced.select(*keys, time, tie, "item_type", "item", F.lit(False).alias("moves"), F.lit(False).alias("sure"), F.lit(True).alias("asks")))
        limits = selections.groupBy(F.col("item").alias("item")).agg(F.max("max_level").alias("_limit"))
        steps = steps.join(limits, "item", "left")
        # below the limit every step counts, above it only sure ones do
        one = F.lit(1).cast("long")
        s = per_item.running(per_item.tag(steps), _all=running_sum(F.when(F.col("moves"), one).otherwise(0)), _sure=running_sum(F.when(F.col("sure"), one).otherwise(0)))
        s = per_item.running(s.withColumn("_mark", F.when(F.col("moves") & (1 + F.col("_all") == F.greatest("_limit", F.lit(1))), F.col("_sure"))), _at=last_seen(F.col("_mark"), exclusive=True))
        s = per_item.untag(s)
        earlier, sures = 1 + F.col("_all") - F.col("moves").cast("long"), F.col("_sure") - F.col("sure").cast("long")
        level = F.when(F.col("_limit").isNull() | (earlier <= F.col("_limit")), earlier).otherwise(F.greatest(F.col("_limit"), one) + sures - F.coalesce("_at", F.lit(0)))
        levels = s.withColumn("_level", level).groupBy(*keys, tie).agg(F.max(F.when(~F.col("asks"), F.col("_level"))).alias("level"), F.max(F.when(F.col("asks"), F.col("_level"))).alias("_own"))
        d = d.join(levels, [*keys, tie])
        at_max = F.coalesce(F.col("has") & (F.coalesce("_own", "level") >= F.col("max_level")), F.lit(False))
        d = cut_lineage(d.withColumn("reason", F.when(F.col("cursor_score") < 20, "selection_pointer_unconfirmed").when(at_max, "item_already_at_normal_max")
                                     .when(~F.col("has") & F.col("full") & F.col("needs_review"), "low_confidence_beyond_standard_slots")))
        plain = F.coalesce(~F.col("reason").isin("item_already_at_normal_max", "low_confidence_beyond_standard_slots"), F.lit(True))
        asked = d.filter(F.col("needs_review") & ~F.col("confirmed") & plain & (F.size("grown") > 0)).withColumn("_g", F.explode("grown"))
        asked = asked.select(*keys, tie, "place", "later", "_g.level", F.col("_g.place").alias("_p"), F.substring_index("_g.place", ":", 1).alias("item_type"), F.substring_index("_g.place", ":", -1).cast("long").alias("slot"))
        held = asked.join(owned.withColumnRenamed("item", "to_item"), [*listed, "slot"]).filter(before("at"))
        only = held.groupBy(*keys, tie).agg(F.count(F.lit(1)).alias("_n"), F.first(F.element_at("later", F.col("_p")) >= F.col("level")).alias("_ok"), F.first("item_type").alias("_type"), F.first("to_item").alias("_item"), F.first("slot").alias("_slot"))
        only = only.filter("_n = 1 AND _ok").drop("_n")
        again = d.select(*rows.columns, "confirmed", "has", "joins", "level", "reason", F.col("slot").alias("own_slot")).join(only, [*keys, tie], "left").withColumn("_now", F.col("_ok").isNotNull())
        if again.filter("_now <> fired OR (fired AND (_item <> to_item OR _slot <> to_slot))").isEmpty():
            break
        rows = cut_lineage(again.withColumns({"fired": F.col("_now"), "to_type": F.col("_type"), "to_item": F.col("_item"), "to_slot": F.col("_slot")}).select(rows.columns))
    retro = F.col("fired") | F.col("confirmed")
    excluded = ~retro & F.col("reason").isNotNull()
    new = ~retro & ~excluded & ~F.col("has")
    kind = F.when(excluded, "excluded").when(new, "new").otherwise("upgrade")
    out = again.select(*keys, tie, kind.alias("event_type"), F.when(retro, "level_up_retrospective").otherwise("level_up").alias("event_source"), F.when(excluded, F.col("reason")).alias("exclusion_reason"),
                       F.coalesce("to_type", "item_type").alias("item_type"), F.coalesce("to_item", "item").alias("item"), F.when(~excluded, F.coalesce("to_slot", "own_slot")).alias("slot"),
                       F.when(~excluded & ~new, F.col("level")).alias("level_before"), F.when(new, 1).when(~excluded, F.col("level") + 1).cast("long").alias("level_after"))
    first = opening.select(*keys, F.lit(None).cast(out.schema[tie].dataType).alias(tie), F.lit("initial_state").alias("event_type"), F.lit("initial_state").alias("event_source"), F.lit(None).cast("string").alias("exclusion_reason"),
                           "item_type", "item", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("long").alias("level_before"), F.lit(1).cast("long").alias("level_after"))
    return first.unionByName(out)


def inferred_initial_levels(observations: DataFrame, upgrades: DataFrame, key: str = "session_id") -> DataFrame:
    """Opening level of an item: an observed level minus the upgrades before it; the last usable observation counts."""
    count = running_sum(F.when(F.col("_right").isNotNull(), 1).otherwise(0).cast("long"))
    d = stream_join(observations, upgrades, {"_n": count}, keys=[key, "item"], right_first=False)
    d = d.withColumn("_level", F.col("observed_level") - F.coalesce("_n", F.lit(0))).filter("_level >= 1")
    return d.groupBy(key, "item").agg(F.max_by("_level", F.struct("t_ms", "event_id")).alias("level_after"))


def reward_eligibility(chests: DataFrame, gains: DataFrame, *, maximum: Column, key: str = "session_id", item: str = "item") -> DataFrame:
    """Items a chest can still upgrade: owned before it and below their maximum.

    ``gains``: ``t_ms, item, reported_level``; a reported level is a lower bound, so the level after n gains is the
    largest of ``reported_i + (n - i)``, a running maximum of ``reported_i - i`` plus ``n``.
    """
    order = time_order(gains, (key, item))
    d = order.running(order.tag(gains), _no=running_sum(F.lit(1).cast("long")))
    lead = F.coalesce(F.col("reported_level"), F.lit(0)) - F.col("_no")
    d = order.untag(order.running(d.withColumn("_lead", lead), _best=running_max(F.col("_lead"))))
    d = d.withColumn("level", F.col("_no") + F.greatest("_best", F.lit(0)))
    items = gains.select(key, item).distinct()
    asked = chests.join(items, key)
    state = asof(asked, d.select(key, item, "t_ms", "event_id", "level"), ["level"], strict=True, keys=[key, item])
    return state.filter(F.col("level").isNotNull()).withColumn("upgradeable", F.col("level") < maximum)
