"""Which agent touched what, what depends on it, under whose authority, and what can be undone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spoor.functions import fixed
from spoor.functions.carry import along
from spoor.functions.exprs import first_of, micros, risk_name, risk_rank
from spoor.session import scratch_path

RESOURCE = ("session_id", "resource")
IN_TIME = ("ts", "id")


def _touches(df: DataFrame) -> DataFrame:
    return df.filter(F.coalesce(F.col("resource"), F.lit("")) != "")


def resource_index(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """G1. Every touch of a resource in order, per session."""
    placed = along(_touches(df), RESOURCE, IN_TIME, position="touch_no", slice_rows=slice_rows)
    return placed.select(
        "session_id", "resource", "touch_no", "id", "chain_id", "sequence", "agent_id", "action_type", "ts"
    )


def assign_turns(df: DataFrame, gap_seconds: int, slice_rows: int | None = None) -> DataFrame:
    """G2. Number the runs of one agent in a session that lie at most ``gap_seconds`` apart."""
    who = ("session_id", "agent_id")
    timed = df.withColumn("__us", micros(F.col("ts")))
    timed = along(timed, who, IN_TIME, lag={"__before": "__us"}, slice_rows=slice_rows)
    starts = F.col("__before").isNull() | (F.col("__us") - F.col("__before") > gap_seconds * 1_000_000)
    return along(
        timed, who, IN_TIME, running={"turn": starts.cast("long")}, slice_rows=slice_rows, dealt=True
    ).drop("__us", "__before")


def dependency_edges(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """G3. Agent → agent edges: one touched a resource right after the other, in causal order."""
    placed = along(_touches(df), RESOURCE, IN_TIME, lag={"source_agent": "agent_id"}, slice_rows=slice_rows)
    return (
        placed.filter(F.col("source_agent") != F.col("agent_id"))
        .groupBy("session_id", "source_agent", F.col("agent_id").alias("target_agent"))
        .agg(F.count(F.lit(1)).alias("n"), F.countDistinct("resource").alias("resources"))
    )


def blast_radius(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """G4. Later touches of the same resource, and how many of them by other agents.

    Later touches are the total less the place, so no row is compared with another.
    """
    rows = along(_touches(df), RESOURCE, IN_TIME, position="__p", total="__n", slice_rows=slice_rows)
    rows = along(rows, (*RESOURCE, "agent_id"), IN_TIME, position="__pa", total="__na", slice_rows=slice_rows)
    later = F.col("__n") - F.col("__p")
    return rows.select(
        "id",
        "session_id",
        "resource",
        "agent_id",
        later.alias("later_touches"),
        (later - (F.col("__na") - F.col("__pa"))).alias("later_by_others"),
    )


def co_turn(turns: DataFrame) -> DataFrame:
    """G5. Receipts of the same turn on other resources; takes ``assign_turns`` output. Advisory.

    Counted per turn and per turn and resource, then looked up, so a long turn is never one group.
    """
    turn = ("session_id", "agent_id", "turn")
    touches = _touches(turns)
    per_resource = touches.groupBy(*turn, "resource").agg(F.count(F.lit(1)).alias("__same"))
    per_turn = per_resource.groupBy(*turn).agg(F.sum("__same").alias("__all"))
    counts = per_resource.join(per_turn, list(turn)).select(
        *turn, "resource", (F.col("__all") - F.col("__same")).alias("co_turn_receipts")
    )
    return touches.join(counts, [*turn, "resource"]).select("id", *turn, "resource", "co_turn_receipts")


def turn_overlaps(turns: DataFrame, gap_seconds: int) -> DataFrame:
    """G6. Agents whose turns on one resource overlap in time, with the number of overlaps.

    Two spans overlap when one holds the start of the other. Each span is filed in the at most
    three cells it touches on the grid of its own size (the gap times a power of two); each start
    is looked up once per grid its resource uses. Turns of one agent lie more than a gap apart, so
    a cell holds a few spans per agent however often a hot resource is touched, and no span is
    compared with all others.
    """
    touches = _touches(turns).withColumn("__us", micros(F.col("ts")))
    spans = touches.groupBy(*RESOURCE, "agent_id", "turn").agg(F.min("__us").alias("lo"), F.max("__us").alias("hi"))
    width = gap_seconds * 1_000_000
    spans = (
        spans.withColumn("__b0", F.floor(F.col("lo") / width))
        .withColumn("__b1", F.floor(F.col("hi") / width))
        .withColumn("level", F.floor(F.log2(F.greatest(F.col("__b1") - F.col("__b0"), F.lit(1)))).cast("int"))
    )
    cells = F.explode(F.expr("sequence(shiftright(__b0, level), shiftright(__b1, level))"))
    filed = spans.select(*RESOURCE, F.col("agent_id").alias("holder"), "lo", "hi", "level", cells.alias("cell"))
    # At most one entry per power of two, so the set stays tiny.
    grids = spans.groupBy(*RESOURCE).agg(F.collect_set("level").alias("levels"))
    starts = (
        spans.select(*RESOURCE, F.col("agent_id").alias("comer"), F.col("lo").alias("at"), "__b0")
        .join(grids, list(RESOURCE))
        .select(*RESOURCE, "comer", "at", "__b0", F.explode("levels").alias("level"))
        .withColumn("cell", F.expr("shiftright(__b0, level)"))
        .drop("__b0")
    )
    held = (
        (F.col("holder") != F.col("comer"))
        & F.col("at").between(F.col("lo"), F.col("hi"))
        # Equal starts would count from both sides.
        & ((F.col("at") != F.col("lo")) | (F.col("holder") < F.col("comer")))
    )
    return (
        filed.join(starts, [*RESOURCE, "level", "cell"])
        .filter(held)
        .groupBy(
            *RESOURCE, F.least("holder", "comer").alias("agent_a"), F.greatest("holder", "comer").alias("agent_b")
        )
        .agg(F.count(F.lit(1)).alias("overlaps"))
    )


def overlap_counts(turns: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """G6. For each agent's turn on a resource: its span and how many spans of other agents overlap it.

    A sweep: starts and ends in order, with running counts of both. What overlaps a span are all that
    start before it ends less all that end before it starts, so a resource costs two rows a span
    however many agents share it, and no two spans meet. Takes ``assign_turns`` output.
    """
    touches = _touches(turns).withColumn("__us", micros(F.col("ts")))
    span = (*RESOURCE, "agent_id", "turn")
    spans = touches.groupBy(*span).agg(F.min("__us").alias("lo"), F.max("__us").alias("hi"))
    # At one instant starts come first: spans that only touch overlap.
    edges = F.array(
        F.struct(F.col("lo").alias("at"), F.lit(0).alias("ends")), F.struct(F.col("hi").alias("at"), F.lit(1).alias("ends"))
    )
    events = spans.select(*span, F.inline(edges))
    order = ("at", "ends", "agent_id", "turn")
    starts, ends = (1 - F.col("ends")).cast("long"), F.col("ends").cast("long")
    events = along(events, RESOURCE, order, running={"__starts": starts, "__ends": ends}, slice_rows=slice_rows)
    events = along(events, (*RESOURCE, "agent_id"), order, running={"__own_starts": starts, "__own_ends": ends}, slice_rows=slice_rows)
    others = F.when(F.col("ends") == 1, F.col("__starts") - F.col("__own_starts")).otherwise(F.col("__own_ends") - F.col("__ends"))
    found = events.groupBy(*span).agg(F.min("at").alias("__lo"), F.max("at").alias("__hi"), F.sum(others).alias("overlaps"))
    instant = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select(*span, instant("__lo").alias("first_ts"), instant("__hi").alias("last_ts"), "overlaps")


def contended_resources(df: DataFrame, k: int) -> DataFrame:
    """G7. The ``k`` resources touched by the most agents, at least two."""
    return (
        _touches(df)
        .groupBy("resource")
        .agg(F.countDistinct("agent_id").alias("agents"), F.count(F.lit(1)).alias("touches"))
        .filter("agents >= 2")
        .orderBy(F.desc("agents"), F.desc("touches"), "resource")
        .limit(k)
    )


def identity_coverage(df: DataFrame) -> DataFrame:
    """G8. Receipts with a resource, of all."""
    has = F.coalesce(F.col("resource"), F.lit("")) != ""
    return df.groupBy("session_id").agg(
        F.count(F.when(has, 1)).alias("indexed"), F.count(F.lit(1)).alias("receipts")
    )


def agent_risk(df: DataFrame) -> DataFrame:
    """G9. The highest risk each agent took in a session."""
    return df.groupBy("session_id", "agent_id").agg(
        risk_name(F.max(risk_rank(F.col("risk_level")))).alias("max_risk"), F.count(F.lit(1)).alias("receipts")
    )


def verify_delegations(delegations: DataFrame, trail: DataFrame) -> DataFrame:
    """G10. Check each delegation link and name the first failing step.

    ``delegations``: chain_id, principal_id, parent_chain_id, parent_receipt_id, delegator_id.
    """
    parents = trail.groupBy(F.col("chain_id").alias("parent_chain_id")).agg(
        F.min("issuer_id").alias("__i0"),
        F.max("issuer_id").alias("__i1"),
        F.min("principal_id").alias("__p0"),
        F.max("principal_id").alias("__p1"),
    )
    # Only the receipts some delegation names; few enough to broadcast as a rule.
    named = ["parent_chain_id", "parent_receipt_id"]
    receipts = (
        trail.select(F.col("chain_id").alias("parent_chain_id"), F.col("id").alias("parent_receipt_id"))
        .join(delegations.select(*named).distinct(), named, "left_semi")
        .distinct()
        .withColumn("__found", F.lit(True))
    )
    joined = delegations.join(parents, "parent_chain_id", "left").join(
        receipts, ["parent_chain_id", "parent_receipt_id"], "left"
    )
    delegator, principal = F.col("delegator_id"), F.col("principal_id")
    outcome = first_of(
        [
            (F.col("__i0").isNull(), "no_parent_chain"),
            (F.col("__found").isNull(), "no_parent_receipt"),
            ((F.col("__i0") != delegator) | (F.col("__i1") != delegator), "wrong_delegator"),
            ((F.col("__p0") != principal) | (F.col("__p1") != principal), "principal_changed"),
        ],
        "ok",
    )
    return joined.select("chain_id", "parent_chain_id", "parent_receipt_id", outcome.alias("delegation_outcome"))


def delegation_tree(edges: DataFrame, chains: DataFrame, max_rounds: int = 40) -> DataFrame:
    """G11. Root and depth of every chain; chains on or below a cycle get none.

    ``edges``: chain_id, parent_chain_id, one per chain; ``chains``: chain_id. Each round doubles
    how far a chain has looked up, so depth d takes log2(d) rounds. A round is written to the
    shared folder, which cuts the lineage; it stops when a round finds no new root.
    """
    spark = edges.sparkSession
    parent = edges.groupBy("chain_id").agg(F.min("parent_chain_id").alias("up"))
    known = chains.select("chain_id").union(parent.select(F.col("up"))).distinct()
    # up: how far the chain has looked; done: that is a root.
    state = known.join(parent, "chain_id", "left").select(
        "chain_id",
        F.coalesce("up", "chain_id").alias("up"),
        F.when(F.col("up").isNull(), 0).otherwise(1).cast("long").alias("depth"),
        F.col("up").isNull().alias("done"),
    )
    path = scratch_path(spark, "tree")
    found = -1
    for turn in range(max_rounds):
        state.write.parquet(f"{path}/{turn}")
        state = spark.read.parquet(f"{path}/{turn}")
        done = state.filter("done").count()
        if done == found:
            break
        found = done
        above = state.select(
            F.col("chain_id").alias("up"), F.col("up").alias("__up"), F.col("depth").alias("__d"), F.col("done").alias("__done")
        )
        further = state.join(above, "up", "left")
        state = further.select(
            "chain_id",
            F.when(F.col("done"), F.col("up")).otherwise(F.col("__up")).alias("up"),
            F.when(F.col("done"), F.col("depth")).otherwise(F.col("depth") + F.col("__d")).alias("depth"),
            (F.col("done") | F.col("__done")).alias("done"),
        )
    else:
        raise RuntimeError(f"delegations are still open after {max_rounds} rounds")
    return state.select(
        "chain_id",
        F.when(F.col("done"), F.col("up")).alias("root_chain_id"),
        F.when(F.col("done"), F.col("depth")).alias("depth"),
        (~F.col("done")).alias("cyclic"),
    )


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """G12. Every name reachable from the roots, with its distance.

    ``edges``: src, dst; ``roots``: name. Each round joins only the names found last and is
    written to the shared folder, so lineage stays short and a lost executor repeats one round.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst").distinct()
    path = scratch_path(spark, "reach")
    links.write.parquet(f"{path}/links")
    links = spark.read.parquet(f"{path}/links")
    found = roots.select("name").distinct().withColumn("distance", F.lit(0).cast("long"))
    turn = 0
    while True:
        found.write.parquet(f"{path}/found/distance_no={turn}")
        last = spark.read.parquet(f"{path}/found/distance_no={turn}")
        if last.isEmpty():
            break
        seen = spark.read.parquet(f"{path}/found").select("name")
        step = last.join(links, F.col("name") == F.col("src")).select(F.col("dst").alias("name")).distinct()
        turn += 1
        found = step.join(seen, "name", "left_anti").withColumn("distance", F.lit(turn).cast("long"))
    return spark.read.parquet(f"{path}/found").select("name", "distance")


def ungrounded(df: DataFrame, grants: DataFrame) -> DataFrame:
    """G13. High and critical receipts without a grant whose subject is their principal.

    ``grants``: grant_ref, subject; joined without a hint, because grants grow with the users.
    """
    risky = df.filter(F.col("risk_level").isin(*fixed.RISK_LEVELS[2:]))
    known = grants.groupBy("grant_ref").agg(F.min("subject").alias("subject"))
    outcome = first_of(
        [
            (F.coalesce(F.col("grant_ref"), F.lit("")) == "", "UNGROUNDED_PRINCIPAL"),
            (F.col("subject").isNull(), "UNGROUNDED_PRINCIPAL"),
            (F.col("subject") != F.col("principal_id"), "PRINCIPAL_GRANT_MISMATCH"),
        ]
    )
    return (
        risky.join(known, "grant_ref", "left")
        .withColumn("grant_outcome", outcome)
        .filter("grant_outcome IS NOT NULL")
        .select("chain_id", "sequence", "id", "principal_id", "grant_ref", "grant_outcome")
    )


def grant_activity(df: DataFrame) -> DataFrame:
    """G14. What was done under each grant, across chains."""
    return (
        df.filter(F.coalesce(F.col("grant_ref"), F.lit("")) != "")
        .groupBy("grant_ref")
        .agg(
            F.count(F.lit(1)).alias("receipts"),
            F.countDistinct("chain_id").alias("chains"),
            F.countDistinct("resource").alias("resources"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def reversals(df: DataFrame) -> DataFrame:
    """G15. Check each reversal against the receipt it reverses."""
    wanted = df.filter(F.col("reversal_of").isNotNull()).select(F.col("reversal_of").alias("id")).distinct()
    originals = (
        df.select("id", "chain_id", "action_type")
        .join(wanted, "id", "left_semi")
        .groupBy(F.col("id").alias("reversal_of"))
        .agg(F.min(F.struct("chain_id", "action_type")).alias("__o"))
        .select("reversal_of", F.col("__o.chain_id").alias("__chain"), F.col("__o.action_type").alias("__type"))
    )
    outcome = first_of(
        [
            (F.col("__chain").isNull(), "no_original"),
            (F.col("__chain") != F.col("chain_id"), "other_chain"),
            (F.col("__type") != F.col("action_type"), "other_action"),
            (F.col("status") != "success", "not_successful"),
        ],
        "ok",
    )
    return (
        df.filter(F.col("reversal_of").isNotNull())
        .select("id", "chain_id", "action_type", "status", "reversal_of")
        .join(originals, "reversal_of", "left")
        .select("id", "chain_id", "reversal_of", outcome.alias("reversal_outcome"))
    )


def open_reversals(df: DataFrame, as_of: str) -> DataFrame:
    """G16. Reversible receipts whose window is open at ``as_of`` and that nobody has reversed."""
    until = F.col("ts") + F.make_dt_interval(secs=F.col("reversal_window_seconds").cast("decimal(18,6)"))
    reversed_ids = df.filter((F.col("status") == "success") & F.col("reversal_of").isNotNull()).select(
        F.col("reversal_of").alias("id")
    )
    return (
        df.filter(F.col("reversible") & (until > F.expr(f"timestamp_ntz '{as_of}'")))
        .select("id", "chain_id", "resource", until.alias("open_until"))
        .join(reversed_ids, "id", "left_anti")
    )


def drift_gaps(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """G17. Touches whose before-hash is not what the touch before left: something else wrote."""
    placed = along(
        _touches(df), ("target_system", "resource"), IN_TIME, lag={"expected_hash": "after_hash"}, slice_rows=slice_rows
    )
    return placed.filter(F.col("before_hash") != F.col("expected_hash")).select(
        "resource", "id", "expected_hash", "before_hash"
    )


# Actions that replace what was there, so that nothing before them can be undone
# on its own.
BARRIERS = (
    "filesystem.file.create",
    "filesystem.file.delete",
    "filesystem.file.move",
    "filesystem.directory.create",
    "filesystem.directory.delete",
    "data.api.delete",
)


def undo_scope(df: DataFrame, slice_rows: int | None = None) -> DataFrame:
    """G18. How many later touches an undo must take along, up to the next barrier; is it the tip?"""
    key = ("target_system", "resource")
    rows = along(_touches(df), key, IN_TIME, position="__p", total="__n", slice_rows=slice_rows)
    barrier = F.when(F.col("action_type").isin(*BARRIERS), F.col("__p"))
    rows = along(rows, key, IN_TIME, next_seen={"__barrier": barrier}, slice_rows=slice_rows)
    return rows.select(
        "id",
        "resource",
        (F.col("__p") == F.col("__n")).alias("tip"),
        F.col("__barrier").isNotNull().alias("barred"),
        (F.coalesce("__barrier", "__n") - F.col("__p")).alias("undo_touches"),
    )
