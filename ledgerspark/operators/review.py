"""Reviewer decisions: replay, undo, bulk recording, and preview of rule changes.

Decisions are an append-only table ordered by ``seq``.  Replaying them needs no loop: each part
of a row's final state depends on a first or last decision of some kind, which are plain
aggregates.
"""

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions.text import norm_key
from ledgerspark.operators.changes import CHANGE_COLUMNS, REVIEW_SLOT, change_count
from ledgerspark.operators.dedupe import (
    NEAR, assign_status, build_reasons, high_reason, hot_groups, is_parsed, mark_duplicates,
)
from ledgerspark.operators.numbering import number_rows
from ledgerspark.operators.rules import Rules, categorise
from ledgerspark.operators.skew import BROADCAST_ROWS, HOT_ROWS, fits_broadcast, lookup_join, salted_join
from ledgerspark.sinks.staging import stage

ACTIONS = ["category", "duplicate", "exclude", "confirm"]
CARRY_BLOCK = 1_000_000


def active_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions that were not undone; undo entries themselves stay."""
    undone = (
        decisions.filter(F.col("action") == "undo")
        .select(F.col("undo_of").alias("id"))
        .distinct()
    )
    return decisions.join(undone, "id", "left_anti").select(S.DECISIONS.fieldNames())


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The last decision in force per row."""
    fields = [f for f in S.DECISIONS.fieldNames() if f != "row_id"]
    return (
        active_decisions(decisions)
        .filter(F.col("action") != "undo")
        .groupBy("row_id")
        .agg(F.max(F.struct(*fields)).alias("d"))
        .select("row_id", "d.*")
    )


def _is(action: str) -> Column:
    return F.col("action") == action


def decision_effects(decisions: DataFrame) -> DataFrame:
    """What all decisions in force mean for each row: one line per ``row_id``.

    ``added`` holds one entry per duplicate or exclude decision because each adds a review
    reason to the row.
    """
    moves = _is("duplicate") | _is("exclude")
    named = _is("category") & (F.col("after") != S.UNCATEGORISED)
    text = F.when(
        _is("duplicate"),
        F.concat(F.lit("marked duplicate of "), "after", F.lit(" by reviewer")),
    ).otherwise(S.R_EXCLUDED)
    return (
        active_decisions(decisions)
        .filter(F.col("action").isin(ACTIONS))
        .groupBy("row_id")
        .agg(
            F.max(F.when(_is("category"), F.struct("seq", "after"))).alias("last_category"),
            F.max(F.when(moves, F.struct("seq", "action"))).alias("last_move"),
            F.max(F.when(_is("duplicate"), F.struct("seq", "after"))).alias("last_duplicate"),
            F.max(F.struct("seq", "action", "at")).alias("latest"),
            F.min(F.when(named, F.col("seq"))).alias("first_named"),
            F.min(F.when(moves, F.col("seq"))).alias("first_move"),
            F.collect_list(F.when(moves, F.struct("seq", text.alias("text")))).alias("added"),
        )
    )


def apply_decisions(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """Records after replaying the decisions in order; source cells stay untouched.

    A category decision replaces the category and the unmapped reason and reopens the row;
    duplicate and exclude move the row and add a reason; confirm only marks it.  Decisions on
    unknown rows have no effect.
    """
    e = decision_effects(decisions).withColumnRenamed("row_id", "id")
    joined = records.join(e, "id", "left")
    recategorised = F.col("last_category").isNotNull()
    rest = F.when(
        recategorised, F.array_remove(F.col("reasons"), S.R_UNMAPPED)
    ).otherwise(F.col("reasons"))
    # a named category leaves a note where no other reason is left at that moment
    noted = (
        (F.size(rest) == 0)
        & F.col("first_named").isNotNull()
        & (F.col("first_move").isNull() | (F.col("first_named") < F.col("first_move")))
    )

    def entry(cond: Column, seq: Column, text: str) -> Column:
        return F.when(
            cond, F.array(F.struct(seq.alias("seq"), F.lit(text).alias("text")))
        ).otherwise(F.array().cast("array<struct<seq:bigint,text:string>>"))

    unmapped = F.col("last_category.after") == S.UNCATEGORISED
    new = F.array_sort(
        F.concat(
            F.coalesce("added", F.array().cast("array<struct<seq:bigint,text:string>>")),
            entry(noted, F.col("first_named"), S.R_EDITED),
            entry(unmapped, F.col("last_category.seq"), S.R_UNMAPPED),
        )
    )
    open_again = F.col("latest.action") == "category"
    keep = [c for c in records.columns if c not in ("decided", "decided_at")]
    return (
        joined.withColumn("reasons", F.concat(rest, F.transform(new, lambda n: n["text"])))
        .withColumn("category", F.coalesce("last_category.after", "category"))
        .withColumn(
            "status",
            F.when(F.col("last_move.action") == "duplicate", "duplicate")
            .when(F.col("last_move.action") == "exclude", "excluded")
            .otherwise(F.col("status")),
        )
        .withColumn("duplicate_of", F.coalesce("last_duplicate.after", "duplicate_of"))
        .withColumn("decided", F.when(~open_again, F.col("latest.action")))
        .withColumn("decided_at", F.when(~open_again, F.col("latest.at")))
        .select(*keep, "decided", "decided_at")
    )


def _previous(events: DataFrame, value: Column, name: str) -> DataFrame:
    """Add the last non-null ``value`` before each event of the same row.

    Events are taken in blocks of ``seq``, so a row with very many decisions is spread over
    several tasks; each block starts from the last value of the blocks before it.
    """
    keys = ["row_id", "_block"]
    blocked = events.withColumn("_v", value).withColumn(
        "_block", F.floor(F.col("seq") / CARRY_BLOCK)
    )
    carried = (
        blocked.groupBy(keys)
        .agg(F.max(F.when(F.col("_v").isNotNull(), F.struct("seq", "_v")))["_v"].alias("_end"))
        .withColumn(
            "_carry",
            F.last("_end", ignorenulls=True).over(
                W.partitionBy("row_id").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
            ),
        )
        .drop("_end")
    )
    inside = F.last("_v", ignorenulls=True).over(
        W.partitionBy(keys).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    )
    return (
        blocked.join(carried, keys)
        .withColumn(name, F.coalesce(inside, "_carry"))
        .drop("_v", "_block", "_carry")
    )


def reviewer_changes(records: DataFrame, decisions: DataFrame) -> DataFrame:
    """One change-log entry per decision in force, with the state before it.

    ``records`` are the records as cleaned, before decisions.
    """
    base = records.select(
        F.col("id").alias("row_id"), "ord", "source_file", "source_sheet", "source_row",
        F.col("category").alias("_category"), F.col("status").alias("_status"),
        F.lit(True).alias("_known"),
    )
    undone = decisions.select(F.col("id").alias("undo_of"), F.col("action").alias("_undone"))
    active = active_decisions(decisions)
    events = _previous(active, F.when(_is("category"), F.col("after")), "_prev_category")
    status = F.when(_is("duplicate"), "duplicate").when(_is("exclude"), "excluded")
    events = _previous(events, status, "_prev_status")
    events = events.join(undone, "undo_of", "left")
    located = salted_join(events, base, ["row_id"], "id").filter(
        F.col("_known") | _is("undo")
    )

    def pick(**by_action) -> Column:
        out = F.lit(None).cast("string")
        for action, value in by_action.items():
            out = F.when(_is(action), value).otherwise(out)
        return out

    before_status = F.coalesce("_prev_status", "_status")
    return located.select(
        F.col("row_id").alias("id"),
        "ord",
        F.lit(REVIEW_SLOT).alias("slot"),
        "seq",
        pick(
            category=F.lit("category"), duplicate=F.lit("disposition"),
            exclude=F.lit("disposition"), confirm=F.lit("review"), undo=F.lit("decision"),
        ).alias("field"),
        pick(
            category=F.coalesce("_prev_category", "_category"), duplicate=before_status,
            exclude=before_status, confirm=F.lit("flagged"), undo=F.col("_undone"),
        ).alias("before"),
        pick(
            category=F.col("after"), duplicate=F.lit("duplicate"), exclude=F.lit("excluded"),
            confirm=F.lit("confirmed as is"), undo=F.lit("undone"),
        ).alias("after"),
        pick(
            category=F.coalesce("rule", F.lit("manual review")),
            duplicate=F.lit("marked duplicate by reviewer"),
            exclude=F.lit("excluded by reviewer"),
            confirm=F.lit("reviewer confirmation"),
            undo=F.lit("reviewer undo"),
        ).alias("rule"),
        F.lit("you").alias("who"),
        "at",
        "source_file", "source_sheet", "source_row",
    ).select(CHANGE_COLUMNS)


def undo(decisions: DataFrame, ids: list[str], first_seq: int, at: dt.datetime) -> DataFrame:
    """Undo entries to append for the given decisions; those already undone are left out."""
    order = F.array_position(F.array(*[F.lit(i) for i in ids]), F.col("id"))
    target = active_decisions(decisions).filter(
        F.col("id").isin(ids) & (F.col("action") != "undo")
    )
    return target.select(
        (F.lit(first_seq - 1) + order).cast("bigint").alias("seq"),
        F.concat(F.lit("undo-"), "id").alias("id"),
        "row_id",
        F.lit("undo").alias("action"),
        F.lit(None).cast("string").alias("after"),
        F.lit(None).cast("string").alias("rule"),
        F.lit(None).cast("string").alias("rule_added"),
        F.col("id").alias("undo_of"),
        F.lit(at).cast("timestamp").alias("at"),
    )


def rules_in_force(rules: Rules, decisions: DataFrame) -> Rules:
    """Reviewer rules without those added by a decision that was undone."""
    undone = decisions.filter(_is("undo")).select(F.col("undo_of").alias("id")).distinct()
    gone = (
        decisions.join(undone, "id", "left_semi")
        .filter(F.col("rule_added").isNotNull())
        .select(F.col("rule_added").alias("rule_id"))
        .distinct()
    )
    return Rules(rules.df.join(gone, "rule_id", "left_anti"), rules.high_cents, rules.rows)


def rules_from_decisions(
    records: DataFrame, decisions: DataFrame, high_cents: int = S.DEFAULT_HIGH_CENTS,
    folder: str | None = None,
) -> Rules:
    """The reviewer rules that category decisions in force have added.

    A rule maps the merchant of the decided record to the chosen category; of several for one
    merchant, the last counts.  Undoing a decision takes its rule away.  Cleaning reads rules more
    than once: they are written to ``folder``, a new path, when it is given, and otherwise derived
    from the records again each time.
    """
    adding = active_decisions(decisions).filter(_is("category") & F.col("rule_added").isNotNull())
    named = adding.join(
        records.select(F.col("id").alias("row_id"), "merchant"), "row_id"
    ).withColumn("norm_key", norm_key("merchant"))
    last = F.max(F.struct("seq", "merchant", "after", "rule_added")).alias("last")
    df = named.groupBy("norm_key").agg(last).select(
        "norm_key", F.col("last.merchant").alias("alias"), F.col("last.after").alias("category"),
        F.lit("reviewer").alias("origin"), F.col("last.rule_added").alias("rule_id"),
    )
    return Rules(df if folder is None else stage(df, folder), high_cents)


def decisions_from_bulk(
    rows: DataFrame,
    action: str,
    first_seq: int,
    at: dt.datetime,
    after: str | Column | None = None,
    rule: str | None = None,
    rule_added: str | Column | None = None,
    prefix: str = "d",
) -> DataFrame:
    """Decisions that record the same action for every selected record.

    ``after`` is a category, or for ``duplicate`` a column with the retained row's id.
    ``seq`` counts on from ``first_seq`` in processing order.
    """
    if action not in ACTIONS:
        raise ValueError("unknown action " + action)

    def text(value) -> Column:
        return (value if isinstance(value, Column) else F.lit(value)).cast("string")

    picked = rows.select(
        "ord", F.col("id").alias("row_id"), text(after).alias("after"),
        text(rule).alias("rule"), text(rule_added).alias("rule_added"),
    )
    return number_rows(picked, ["row_id"], "_n").select(
        (F.col("_n") + F.lit(first_seq - 1)).cast("bigint").alias("seq"),
        F.concat(F.lit(prefix + "-"), "row_id").alias("id"),
        "row_id",
        F.lit(action).alias("action"),
        "after",
        "rule",
        "rule_added",
        F.lit(None).cast("string").alias("undo_of"),
        F.lit(at).cast("timestamp").alias("at"),
    )


def review_counts(records: DataFrame) -> DataFrame:
    """One row: pending and reviewed rows of the queue."""
    flagged = (F.size("reasons") > 0) | F.col("decided").isNotNull()
    decided = F.col("decided").isNotNull()
    return records.agg(
        F.count_if(flagged & ~decided & (F.col("status") != "excluded")).alias("pending"),
        F.count_if(flagged & decided).alias("reviewed"),
    )


def record_totals(records: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """One row ``(flagged, changes)``: what a preview starts from; worth storing with a ledger."""
    done = records if decisions is None else apply_decisions(records, decisions)
    flagged = done.agg(F.count_if(F.size("reasons") > 0).alias("flagged"))
    log = records.agg(F.coalesce(F.sum(change_count()), F.lit(0)).alias("n"))
    return flagged.select("flagged", log.scalar().alias("changes"))


def changed_keys(old: Rules, new: Rules) -> DataFrame:
    """Norm keys whose name, category or origin differs between two policies."""
    fields = ["alias", "category", "origin"]
    then = new.df.select("norm_key", *[F.col(f).alias(f"_{f}") for f in fields])
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"_{f}"))
    return old.df.select("norm_key", *fields).join(then, "norm_key", "full_outer").filter(~same).select("norm_key")


def affected_rows(now: DataFrame, old: Rules, new: Rules) -> DataFrame:
    """``now`` with ``_moved``, set where a new policy can change a row's category or duplicates.

    These are the rows of changed norm keys and all rows of the ``(merchant, date, cents)`` groups
    that such rows leave or enter; every group of theirs is then complete, under both policies.
    """
    old, new = old.with_size(), new.with_size()
    known = None not in (old.rows, new.rows)
    keys = changed_keys(old, new).withColumn("_named", F.lit(True))
    named = lookup_join(
        now.withColumn("norm_key", norm_key("merchant_raw")), keys, ["norm_key"], "id",
        old.rows + new.rows if known else None,
    ).drop("norm_key")
    parsed = named.filter(F.col("_named") & is_parsed())
    entered = categorise(parsed.drop("merchant", "category", "category_rule"), new)
    groups = parsed.select(NEAR).union(entered.select(NEAR)).distinct().withColumn("_near", F.lit(True))
    rows = BROADCAST_ROWS if fits_broadcast(groups) else None
    return (
        lookup_join(named, groups, NEAR, "id", rows)
        .withColumn("_moved", F.coalesce("_named", "_near", F.lit(False))).drop("_named", "_near")
    )


def _high(rules: Rules) -> Column:
    limit = F.lit(rules.high_cents).cast("decimal(38,0)")
    return F.coalesce(F.abs("cents") >= limit, F.lit(False))


def preview_rules(
    now: DataFrame, old: Rules, new: Rules, decisions: DataFrame | None = None,
    totals: DataFrame | None = None, hot: list[int] | None = None, folder: str | None = None,
) -> DataFrame:
    """One row: what a change of rules from ``old`` to ``new`` would do.

    ``now`` are the records cleaned under ``old``.  Only affected rows are cleaned again: those of
    ``affected_rows``, without parsing them a second time, and of the others those that a new limit
    flags or clears.  Their differences are added to ``totals`` (``record_totals(now, decisions)``,
    computed when not given).  Rows whose category a reviewer decided keep it.  ``hot`` as in
    ``clean``.  Rows that may change are written to ``folder``, a new path, when it is given;
    otherwise they are looked for again for each part of the answer.
    """
    old, new = old.with_size(), new.with_size()
    crossing = F.array_contains("reasons", high_reason(old.high_cents)) != _high(new)
    marked = affected_rows(now, old, new).filter(F.col("_moved") | crossing)
    if folder is not None:
        marked = stage(marked, folder)
    moved = marked.filter("_moved").drop("_moved")
    renamed = categorise(
        moved.withColumnRenamed("category", "_was").drop(
            "merchant", "category_rule", "status", "duplicate_of", "possible_of", "reasons"
        ),
        new,
    )
    if hot is None:
        # a frequent group needs that many rows
        hot = hot_groups(renamed) if moved.limit(HOT_ROWS).count() == HOT_ROWS else []
    again = build_reasons(assign_status(mark_duplicates(renamed, hot)), new.high_cents)
    crossed = marked.filter(~F.col("_moved")).drop("_moved")
    others = F.filter("reasons", lambda r: r != high_reason(old.high_cents))
    raised = crossed.withColumn(
        "reasons",
        F.when(_high(new), F.array_append(others, F.lit(high_reason(new.high_cents)))).otherwise(others),
    )
    sides = [(moved, -1), (again, 1), (crossed, -1), (raised, 1)]
    both = reduce(DataFrame.unionByName, [
        df.withColumn("_n", change_count()).select(*now.columns, "_n", F.lit(side).alias("_side"))
        for df, side in sides
    ])
    done = both if decisions is None else apply_decisions(both, decisions)
    change = done.agg(
        F.struct(
            F.coalesce(F.sum(F.when(F.size("reasons") > 0, F.col("_side"))), F.lit(0)).alias("flagged"),
            F.coalesce(F.sum(F.col("_n") * F.col("_side")), F.lit(0)).alias("changes"),
        ).alias("by")
    ).scalar()
    recategorised = renamed.filter(F.col("_was") != F.col("category"))
    if decisions is not None:
        decided = (
            active_decisions(decisions).filter(_is("category"))
            .select(F.col("row_id").alias("id")).distinct()
        )
        recategorised = recategorised.join(decided, "id", "left_anti")
    start = record_totals(now, decisions) if totals is None else totals
    return start.select(
        recategorised.agg(F.count("*").alias("n")).scalar().alias("recategorised"),
        F.col("flagged").alias("flagged_now"),
        (F.col("flagged") + change["flagged"]).alias("flagged_then"),
        F.col("changes").alias("changes_now"),
        (F.col("changes") + change["changes"]).alias("changes_then"),
    )
