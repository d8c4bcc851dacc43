"""Named queries over the given tables, one or more per operator."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark import schema as S
from ledgerspark.functions import reasons as fr
from ledgerspark.functions import text as ft
from ledgerspark.operators import changes as ch
from ledgerspark.operators import checks as ck
from ledgerspark.operators import dedupe, review, rules, suggest, totals, views
from ledgerspark.plans import reports
from ledgerspark.plans.clean import clean, parse_rows
from ledgerspark.sinks import digests, pages
from ledgerspark.sinks import ledger as sinks
from ledgerspark.sinks.staging import stage
from ledgerspark.sources import documents, exports, headers
from ledgerspark.sources.tables import repeated_order_keys
from ledgerspark.testing import fixtures as fx
from ledgerspark.testing.dirty_bills import (
    HIGH_CENTS,
    SEGMENT_CATEGORY,
    dirty_bills,
    dirty_rules,
)

AT = dt.datetime(2025, 7, 1, 9, 30)
NEW_HIGH_CENTS = 45_000_000


def records(spark: SparkSession, sf: str) -> DataFrame:
    return clean(dirty_bills(spark, sf), dirty_rules(spark))


def staged(spark: SparkSession, sf: str) -> DataFrame:
    """Records written once, for queries that use them more than once."""
    return stage(records(spark, sf), fx.work_folder(spark))


def reviewed(spark: SparkSession, sf: str) -> DataFrame:
    return review.apply_decisions(records(spark, sf), fx.decision_log(spark, sf))


def kept(spark: SparkSession, sf: str) -> DataFrame:
    return totals.bills(records(spark, sf))


def parsed(spark: SparkSession, sf: str) -> DataFrame:
    return parse_rows(dirty_bills(spark, sf))


def reviewer_rules(spark: SparkSession) -> rules.Rules:
    """Overrides for some named vendors and rules for some unmapped ones."""
    pairs = [
        (f"{seg} VENDOR {v}", "Supplies", f"rule-{seg}-{v}")
        for seg, _ in SEGMENT_CATEGORY
        for v in (3, 31, 32)
    ]
    return rules.rules_from_pairs(spark, pairs, "reviewer", NEW_HIGH_CENTS)


def new_rules(spark: SparkSession) -> rules.Rules:
    return rules.effective_rules(dirty_rules(spark), reviewer_rules(spark))


def _flat(df: DataFrame) -> DataFrame:
    """Only plain values: dates and lists as text, money as bigint."""
    out = []
    for field in df.schema.fields:
        c, kind = F.col(field.name), field.dataType.simpleString()
        if field.name == "ord":
            continue
        if kind in ("date", "timestamp"):
            c = c.cast("string")
        elif kind.startswith("array"):
            c = F.array_join(c, "; ")
        elif kind.startswith("decimal"):
            c = (c * 100 if field.name == "amount" else c).cast("bigint")
        elif kind == "int":
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(out)


def _ids(df: DataFrame) -> DataFrame:
    return df.select("id")


def _dates(df: DataFrame) -> DataFrame:
    return df.withColumn("bill_date", F.col("bill_date").cast("string"))


# --- scalar functions ------------------------------------------------------------------------


def q_strip_ws(s, sf):
    return dirty_bills(s, sf).select("id", ft.strip_ws("invoice_raw").alias("invoice"))


def q_norm_key(s, sf):
    key = ft.norm_key("merchant_raw").alias("norm_key")
    return dirty_bills(s, sf).select(key).groupBy("norm_key").agg(F.count("*").alias("rows"))


def q_amount_cents(s, sf):
    return dirty_bills(s, sf).select(
        "id", ft.amount_cents("amount_raw").alias("cents"),
        ft.amount_error("amount_raw").alias("error"),
    )


def q_bill_date(s, sf):
    return dirty_bills(s, sf).select(
        "id", ft.bill_date("date_raw").cast("string").alias("bill_date"),
        ft.date_error("date_raw").alias("error"),
    )


def q_money_text(s, sf):
    return parsed(s, sf).select(
        "id", ft.money_text("cents").alias("plain"), ft.money_text("cents", True).alias("grouped")
    )


def q_month_key(s, sf):
    return (
        parsed(s, sf).select(ft.month_key("bill_date").alias("month"))
        .groupBy("month").agg(F.count("*").alias("rows"))
    )


def q_reason_key(s, sf):
    return records(s, sf).select(
        "id", F.array_join(F.transform("reasons", fr.reason_key), ",").alias("keys")
    )


def q_keyword_guess(s, sf):
    part = s.read.parquet(f"{sf}/part.parquet")
    return part.select("p_partkey", fr.keyword_guess("p_name").alias("category"))


def q_keyword_guess_documents(s, sf):
    docs = s.read.parquet(f"{sf}/documents.parquet")
    return docs.select("doc_id", fr.keyword_guess("text").alias("category"))


# --- rules -----------------------------------------------------------------------------------


def q_categorise(s, sf):
    return rules.categorise(dirty_bills(s, sf), dirty_rules(s)).select(
        "id", "merchant", "category", "category_rule"
    )


def q_categorise_large_rules(s, sf):
    """The same join when the rules table is too large to broadcast."""
    r = dirty_rules(s)
    large = rules.Rules(r.df, r.high_cents, 10**9)
    return rules.categorise(dirty_bills(s, sf), large).select("id", "merchant", "category")


def q_effective_rules(s, sf):
    out = rules.categorise(dirty_bills(s, sf), new_rules(s))
    return out.groupBy("category", "category_rule").agg(F.count("*").alias("rows"))


def q_rule_impact(s, sf):
    return rules.rule_impact(parsed(s, sf), new_rules(s))


def q_check_rule_snapshot(s, sf):
    """Policy in use against the policy found by grouping the written records."""
    r = dirty_rules(s)
    found = (
        records(s, sf).filter(F.col("category") != "Uncategorised")
        .select(F.col("merchant").alias("alias"), "category").distinct()
    )
    seen = r.df.join(found, ["alias", "category"], "left_semi")
    out = rules.check_rule_snapshot(r, rules.Rules(seen, HIGH_CENTS))
    return out.select(
        F.col("missing").alias("missing"), F.col("unexpected").alias("unexpected"), "ok"
    )


def _preview(s, sf, decisions=None):
    now = staged(s, sf)
    return review.preview_rules(now, dirty_rules(s), new_rules(s), decisions, folder=fx.work_folder(s))


def q_preview_rules(s, sf):
    return _preview(s, sf)


def q_preview_rules_reviewed(s, sf):
    return _preview(s, sf, fx.decision_log(s, sf))


def q_rules_round_trip(s, sf):
    """Rules written as a document and read again, applied to the bills."""
    path = fx.work_folder(s)
    sinks.write_rules(path, reviewer_rules(s))
    loaded = documents.load_rules(s, path)
    out = rules.categorise(dirty_bills(s, sf), rules.effective_rules(dirty_rules(s), loaded))
    return out.groupBy("category", "category_rule").agg(F.count("*").alias("rows"))


# --- cleaning --------------------------------------------------------------------------------


def q_reconcile(s, sf):
    return _flat(totals.reconcile(records(s, sf)))


def q_clean_records(s, sf):
    return _flat(
        records(s, sf).select(
            "id", "invoice", "merchant", "category", "bill_date", "cents", "status",
            "duplicate_of", "possible_of", "reasons",
        )
    )


def q_mark_exact_duplicates(s, sf):
    return records(s, sf).filter(F.col("duplicate_of").isNotNull()).select("id", "duplicate_of")


def q_mark_possible_duplicates(s, sf):
    return records(s, sf).filter(F.col("possible_of").isNotNull()).select("id", "possible_of")


def q_hot_groups(s, sf):
    """Heavily repeated bills: every group is treated as one that must be split."""
    rows = rules.categorise(parsed(s, sf), dirty_rules(s)).withColumn(
        "merchant", F.col("category")
    ).withColumn("bill_date", F.when(F.col("bill_date").isNotNull(), F.lit("2025-01-01").cast("date")))
    rows = rows.withColumn("cents", F.when(F.col("cents").isNotNull(), F.lit(100).cast("bigint")))
    rows = rows.withColumn("invoice", F.substring("invoice", 9, 3))
    hot = dedupe.hot_groups(rows, 50)
    marked = dedupe.assign_status(dedupe.mark_duplicates(rows, hot))
    return marked.select("id", "status", "duplicate_of", "possible_of")


def q_assign_status(s, sf):
    return records(s, sf).groupBy("status").agg(F.count("*").alias("rows"))


def q_build_reasons(s, sf):
    return records(s, sf).select("id", F.array_join("reasons", "; ").alias("reasons"))


def q_repeated_order_keys(s, sf):
    return repeated_order_keys(dirty_bills(s, sf)).select("n")


# --- change log ------------------------------------------------------------------------------


def q_build_changes(s, sf):
    return ch.build_changes(records(s, sf)).select("id", "field", "before", "after", "rule", "who")


def q_change_counts(s, sf):
    c = ch.build_changes(records(s, sf))
    return c.groupBy("field", "rule").agg(F.count("*").alias("rows"))


def _log(s, sf):
    base = staged(s, sf)
    made = review.reviewer_changes(base, fx.decision_log(s, sf))
    return ch.change_log(ch.build_changes(base), made)


def q_reviewer_changes(s, sf):
    made = review.reviewer_changes(staged(s, sf), fx.decision_log(s, sf))
    return made.select("seq", "id", "field", "before", "after", "rule")


def q_change_log(s, sf):
    return _log(s, sf).groupBy("who", "field").agg(F.count("*").alias("rows"))


def q_change_facets(s, sf):
    return ch.change_facets(ch.build_changes(records(s, sf)))


def q_filter_changes(s, sf):
    c = ch.build_changes(records(s, sf))
    return ch.filter_changes(c, who="build", field="date", sheet="ORDERS").select(
        "id", "before", "after"
    )


def q_row_history(s, sf):
    c = ch.build_changes(records(s, sf))
    return ch.filter_changes(c, id="1:1:0").select("id", "field", "before", "after")


def q_numbered_changes(s, sf):
    base = staged(s, sf)
    made = review.reviewer_changes(base, fx.decision_log(s, sf))
    return sinks.numbered_changes(base, made).select("n", "id", "field")


def q_change_log_csv(s, sf):
    path = fx.work_folder(s)
    sinks.write_change_log_csv(path, staged(s, sf))
    back = s.read.option("header", True).option("escape", '"').option("multiLine", False).csv(path)
    # Spark reads an empty field as null
    before = F.coalesce("before", F.lit("")).alias("before")
    return back.select(F.col("n").cast("bigint").alias("n"), "src", "field", before, "after", "rule", "who")


# --- totals ----------------------------------------------------------------------------------


def q_monthly_totals(s, sf):
    return _flat(totals.monthly_totals(kept(s, sf)))


def q_monthly_totals_filled(s, sf):
    return _flat(totals.monthly_totals(kept(s, sf), ("1994-07", "1995-12")))


def q_category_totals(s, sf):
    return _flat(totals.category_totals(kept(s, sf)))


def q_merchant_totals(s, sf):
    out = totals.merchant_totals(totals.bills(staged(s, sf))).withColumn("share", F.round("share", 4))
    return _flat(out)


def q_high_bills(s, sf):
    return _dates(totals.high_bills(kept(s, sf), HIGH_CENTS)).select(
        "id", "invoice", "merchant", "bill_date", "cents"
    )


def q_high_bills_top(s, sf):
    return totals.high_bills(kept(s, sf), HIGH_CENTS, 50).select("id", "cents")


def q_totals_cube(s, sf):
    return _flat(totals.totals_cube(kept(s, sf)))


def q_review_workload(s, sf):
    return totals.review_workload(records(s, sf))


def q_flagged_share(s, sf):
    return totals.flagged_share(records(s, sf))


# --- views -----------------------------------------------------------------------------------


def q_needs_review(s, sf):
    return _ids(views.needs_review(records(s, sf)))


def q_filter_bills(s, sf):
    return _ids(views.filter_bills(records(s, sf), q="vendor 1", category="Rent", flag="clean"))


def q_filter_bills_month(s, sf):
    return _ids(
        views.filter_bills(
            records(s, sf), month="1996-03", flag="flagged", reason="unmapped",
            include_excluded=True,
        )
    )


def q_filter_ledger(s, sf):
    return _ids(views.filter_ledger(records(s, sf), "unparseable", "building", "missing"))


def q_filter_ledger_category(s, sf):
    return _ids(views.filter_ledger(records(s, sf), "clean", "", "category"))


def q_filter_queue(s, sf):
    return _ids(views.filter_queue(views.review_queue(reviewed(s, sf)), "invaliddate"))


def q_filter_queue_decided(s, sf):
    return _ids(views.filter_queue(views.review_queue(reviewed(s, sf)), "decided"))


def q_sort_bills(s, sf):
    return _dates(views.sort_bills(kept(s, sf), "amount", "desc")).select(
        "id", "bill_date", "cents"
    )


def q_sort_bills_unknown_first(s, sf):
    return views.sort_bills(records(s, sf), "date", "asc").select("id")


def q_review_queue(s, sf):
    return views.review_queue(reviewed(s, sf), "amount").select("id")


def q_page(s, sf):
    order = [F.col("bill_date").asc(), F.col("ord").asc()]
    return views.page(kept(s, sf), order, 3, 200).select("id")


def q_stored_page(s, sf):
    """The same page from bills that were sorted and stored once."""
    path = fx.work_folder(s)
    pages.write_pages(totals.bills(staged(s, sf)), [F.col("bill_date").asc(), F.col("ord").asc()], path, 4_000)
    return pages.read_page(s, path, 3).select("id")


def q_stored_page_last(s, sf):
    """The last page of all orders, largest first."""
    path = fx.work_folder(s)
    orders = s.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice")
    pages.write_pages(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], path, 4_000)
    return pages.read_page(s, path, pages.page_count(s, path) - 1)


def q_duplicate_pairs(s, sf):
    return _flat(views.duplicate_pairs(staged(s, sf)))


def q_duplicate_pairs_reviewed(s, sf):
    return _flat(views.duplicate_pairs(stage(reviewed(s, sf), fx.work_folder(s))))


def q_possible_duplicate_pairs(s, sf):
    return _flat(views.possible_duplicate_pairs(staged(s, sf)))


def _two_limits(s, sf):
    rows, r = dirty_bills(s, sf), dirty_rules(s)
    columns = ["id", "status", "reasons"]
    a = clean(rows, r).select(columns)
    return a, clean(rows, rules.Rules(r.df, NEW_HIGH_CENTS, r.rows)).select(columns)


def q_ledger_diff(s, sf):
    """Records under two limits: only rows that cross a limit differ."""
    out = ck.ledger_diff(*_two_limits(s, sf))
    return out.groupBy("only_in", "status").agg(F.sum("copies").alias("rows"))


def q_ledger_diff_stored(s, sf):
    """The same from two stored ledgers, of which only buckets that differ are read."""
    a, b = (digests.write_digested(fx.work_folder(s), df, ["id"], 64) for df in _two_limits(s, sf))
    out = digests.digest_diff(a, b)
    return out.groupBy("only_in", "status").agg(F.sum("copies").alias("rows"))


# --- decisions -------------------------------------------------------------------------------


def q_active_decisions(s, sf):
    return review.active_decisions(fx.decision_log(s, sf)).select("seq", "row_id", "action")


def q_latest_decision(s, sf):
    return review.latest_decision(fx.decision_log(s, sf)).select("row_id", "seq", "action")


def q_apply_decisions(s, sf):
    return _flat(
        reviewed(s, sf).select(
            "id", "category", "status", "duplicate_of", "reasons", "decided", "decided_at"
        )
    )


def q_reconcile_reviewed(s, sf):
    return _flat(totals.reconcile(reviewed(s, sf), with_excluded=True))


def q_review_counts(s, sf):
    return review.review_counts(reviewed(s, sf))


def q_undo(s, sf):
    log = fx.decision_log(s, sf)
    more = review.undo(log, ["d-0-1", "d-0-3", "d-0-6"], 10**12, AT)
    return review.active_decisions(log.unionByName(more)).groupBy("action").agg(
        F.count("*").alias("rows")
    )


def q_rules_in_force(s, sf):
    log = fx.decision_log(s, sf)
    added = log.filter(F.col("rule_added").isNotNull()).select(
        F.col("rule_added").alias("norm_key"), F.col("row_id").alias("alias"),
        F.col("after").alias("category"), F.lit("reviewer").alias("origin"),
        F.col("rule_added").alias("rule_id"),
    )
    return review.rules_in_force(rules.Rules(added), log).df.select("rule_id", "category")


def q_rules_from_decisions(s, sf):
    """Bills cleaned with the rules that decisions have added, some of them undone."""
    r = staged(s, sf)
    added = review.rules_from_decisions(r, fx.decision_log(s, sf), HIGH_CENTS, fx.work_folder(s))
    # the stored records hold the source rows as they were read
    again = clean(r.select(S.SOURCE_ROW_COLUMNS), rules.effective_rules(dirty_rules(s), added))
    return again.groupBy("merchant", "category").agg(F.count("*").alias("rows"))


def q_decisions_from_bulk(s, sf):
    base = records(s, sf)
    picked = views.filter_bills(base, reason="possibledup")
    d = review.decisions_from_bulk(picked, "duplicate", 1, AT, after=F.col("possible_of"))
    return d.select("seq", "row_id", "action", "after")


def q_bulk_then_replay(s, sf):
    base = staged(s, sf)
    picked = views.filter_bills(base, reason="possibledup")
    d = review.decisions_from_bulk(picked, "duplicate", 1, AT, after=F.col("possible_of"))
    return _flat(totals.reconcile(review.apply_decisions(base, d), with_excluded=True))


# --- reports ---------------------------------------------------------------------------------


def q_report_bills(s, sf):
    return _flat(reports.report_bills(records(s, sf)))


def q_report_needs_review(s, sf):
    return _flat(reports.report_needs_review(records(s, sf)))


def q_report_duplicates(s, sf):
    return _flat(reports.report_duplicates(records(s, sf)))


def q_report_change_log(s, sf):
    return reports.report_change_log(_log(s, sf)).select("seq", "id", "field", "before", "after", "rule")


def q_report_summary(s, sf):
    """The records are read once, for their partial totals."""
    partial = totals.partial_totals(records(s, sf), HIGH_CENTS)
    return _summary(reports.summary_of_totals(stage(partial, fx.work_folder(s))))


def q_report_summary_merged(s, sf):
    """Totals of three parts of the records, merged."""
    r = staged(s, sf)
    place = F.col("ord.source_row") % 20
    cut = [place == 0, place == 10, ~place.isin(0, 10)]
    parts = [stage(totals.partial_totals(r.filter(c), HIGH_CENTS), fx.work_folder(s)) for c in cut]
    return _summary(reports.summary_of_totals(stage(totals.merge_totals(parts), fx.work_folder(s))))


def _summary(df):
    """A summary with the source row of high bills, which orders equal amounts."""
    return _flat(df.withColumn("source_row", F.col("ord.source_row")))


def q_report_summary_reviewed(s, sf):
    return _summary(reports.report_summary(stage(reviewed(s, sf), fx.work_folder(s)), HIGH_CENTS))


# --- suggestions -----------------------------------------------------------------------------


def q_uncategorised_merchants(s, sf):
    return suggest.uncategorised_merchants(records(s, sf))


def q_attach_suggestions(s, sf):
    return suggest.attach_suggestions(reviewed(s, sf), fx.suggestion_cache(s, sf)).select(
        "id", "category", "confidence", "reason"
    )


def q_missing_suggestions(s, sf):
    names = suggest.uncategorised_merchants(records(s, sf))
    return suggest.missing_suggestions(names, fx.suggestion_cache(s, sf)).select("norm_key")


def q_suggestions_report(s, sf):
    return suggest.suggestions_report(records(s, sf), fx.suggestion_cache(s, sf))


def q_keyword_suggestions(s, sf):
    return suggest.keyword_suggestions(records(s, sf)).select("id", "category", "reason")


def q_ingest_replies(s, sf):
    return suggest.ingest_replies(fx.model_replies(s, sf)).select(
        "batch_id", "merchant", "category", "confidence", "reason", "error"
    )


def _canned(names: list[str]) -> str:
    """A deterministic stand-in for a model: one answer for all, fails on some batches."""
    import json

    if any(n.endswith("-39") for n in names):
        raise RuntimeError("busy")
    return json.dumps([{"merchant": n, "category": "Rent", "confidence": 0.5, "reason": "r"} for n in names])


def q_suggest(s, sf):
    names = suggest.uncategorised_merchants(records(s, sf))
    return suggest.suggest(names, _canned, batch=12, log=fx.work_folder(s)).select(
        "merchant", "category", "confidence", "reason", "error"
    )


def q_upsert_cache(s, sf):
    cache = fx.suggestion_cache(s, sf)
    names = suggest.uncategorised_merchants(staged(s, sf))
    answers = suggest.latest_answers(
        suggest.suggest(names, _canned, batch=12)
        .filter("error is null")
        .select("norm_key", "merchant", "category", "confidence", "reason",
                F.lit(1).alias("batch_id"), F.lit(0).alias("pos"))
    )
    out = suggest.upsert_cache(cache, names, answers, "openai", "model-2", dt.date(2025, 7, 1))
    return out.select("norm_key", "category", "confidence", "reason", "model")


def q_eval_suggestions(s, sf):
    labelled = fx.labelled_vendors(s, sf)
    cache = fx.suggestion_cache(s, sf)
    return suggest.eval_suggestions(labelled, cache.select("norm_key", "category"))


def q_eval_keywords(s, sf):
    labelled = fx.labelled_vendors(s, sf)
    return suggest.eval_suggestions(labelled, suggest.keyword_predictions(labelled))


def q_eval_misses(s, sf):
    labelled = fx.labelled_vendors(s, sf)
    return suggest.eval_misses(labelled, fx.suggestion_cache(s, sf).select("norm_key", "category"))


# --- checks ----------------------------------------------------------------------------------


def q_check_identity(s, sf):
    return ck.check_identity(dirty_bills(s, sf), staged(s, sf))


def q_check_partition(s, sf):
    return ck.check_partition(records(s, sf))


def q_check_amounts(s, sf):
    return ck.check_amounts(dirty_bills(s, sf), staged(s, sf))


def q_check_review_complete(s, sf):
    r = staged(s, sf)
    return ck.check_review_complete(reports.report_needs_review(r), r)


def q_check_changes_complete(s, sf):
    r = staged(s, sf)
    return ck.check_changes_complete(ch.build_changes(r), r)


def q_check_reviewer_changes(s, sf):
    log = fx.decision_log(s, sf)
    return ck.check_reviewer_changes(review.reviewer_changes(records(s, sf), log), log)


def q_check_policy(s, sf):
    """The policy of all vendors against the vendors that the tables have."""
    stored = dirty_rules(s)
    names = fx.vendor_names(s, sf).select(ft.norm_key("merchant").alias("norm_key"))
    given = rules.Rules(stored.df.join(names, "norm_key", "left_semi"), stored.high_cents)
    return ck.check_policy(given, stored)


def q_check_repeatable(s, sf):
    shuffled = dirty_bills(s, sf).repartition(13, "source_row")
    again = clean(shuffled, dirty_rules(s), hot_rows=50)
    return ck.check_repeatable(records(s, sf), again)


def q_check_repeatable_stored(s, sf):
    """A stored ledger against one cleaned again from rows in another order, by digests."""
    stored = digests.write_digested(fx.work_folder(s), records(s, sf), ["id"], 64)
    shuffled = dirty_bills(s, sf).repartition(13, "source_row")
    again = digests.digested(clean(shuffled, dirty_rules(s), hot_rows=50), ["id"], 64)
    return digests.check_same_digested(stored, again, "repeatable")


def q_check_repeatable_damaged(s, sf):
    """A stored ledger against one with a cent too many in every thousandth row."""
    r = staged(s, sf)
    cent = F.when(F.col("ord.source_row") % 1000 == 0, 1).otherwise(0)
    stored = digests.write_digested(fx.work_folder(s), r, ["id"], 64)
    changed = r.withColumn("cents", F.col("cents") + cent)
    return digests.check_same_digested(stored, digests.digested(changed, ["id"], 64), "repeatable")


def q_check_advisory(s, sf):
    r, cache = staged(s, sf), fx.suggestion_cache(s, sf)
    return ck.check_advisory(suggest.suggestions_report(r, cache), cache, r)


def q_check_advisory_damaged(s, sf):
    """A report without one of its merchants."""
    r, cache = staged(s, sf), fx.suggestion_cache(s, sf)
    report = suggest.suggestions_report(r, cache)
    first = report.agg(F.min("merchant")).scalar()
    return ck.check_advisory(report.filter(F.col("merchant") != first), cache, r)


def q_check_identity_damaged(s, sf):
    """Records that lost one row in a hundred."""
    return ck.check_identity(dirty_bills(s, sf), staged(s, sf).filter("ord.source_row % 1000 <> 0"))


def q_check_amounts_damaged(s, sf):
    """Records with a cent too many in one row."""
    cent = F.when(F.col("ord.source_row") == 20, 1).otherwise(0)
    changed = staged(s, sf).withColumn("cents", F.col("cents") + cent)
    return ck.check_amounts(dirty_bills(s, sf), changed)


def q_check_cache(s, sf):
    return ck.check_cache(fx.suggestion_cache(s, sf))


def q_check_all(s, sf):
    """Every check; the one of reviewer entries fails, as the log has decisions on unknown rows."""
    r, log, cache = staged(s, sf), fx.decision_log(s, sf), fx.suggestion_cache(s, sf)
    again = clean(dirty_bills(s, sf).repartition(13, "source_row"), dirty_rules(s), hot_rows=50)
    return ck.check_all(
        [
            ck.check_identity(dirty_bills(s, sf), r),
            ck.check_partition(r),
            ck.check_amounts(dirty_bills(s, sf), r),
            ck.check_review_complete(reports.report_needs_review(r), r),
            ck.check_changes_complete(ch.build_changes(r), r),
            ck.check_reviewer_changes(review.reviewer_changes(r, log), log),
            q_check_policy(s, sf),
            ck.check_repeatable(r, again),
            ck.check_advisory(suggest.suggestions_report(r, cache), cache, r),
            ck.check_cache(cache),
        ]
    )


# --- files -----------------------------------------------------------------------------------


def q_csv_intake(s, sf):
    """Bills written as CSV exports in two layouts, read again and cleaned."""
    cells = exports.read_csv_exports(s, fx.csv_exports(s, sf))
    cells = stage(cells, fx.work_folder(s))
    rows = headers.map_headers(cells).or_fail(fx.work_folder(s))
    return _flat(totals.reconcile(clean(rows, dirty_rules(s))))


def _with_split_size(s, size, read):
    """What ``read`` returns, with files cut into splits of ``size`` bytes."""
    name = "spark.sql.files.maxPartitionBytes"
    before = s.conf.get(name)
    try:
        s.conf.set(name, str(size))
        return stage(read(), fx.work_folder(s))
    finally:
        s.conf.set(name, before)


def q_csv_intake_split(s, sf):
    """Exports whose header comes late, read in splits that end before it and in large ones."""
    paths = fx.preamble_exports(s, sf)
    parts = []
    for size in (32 << 10, 128 << 20):
        cells = _with_split_size(s, size, lambda: exports.read_csv_exports(s, paths))
        rows = _imported(headers.map_headers(cells).or_fail(fx.work_folder(s)))
        parts.append(rows.withColumn("split", F.lit(size)))
    return parts[0].unionByName(parts[1])


def q_workbook_intake(s, sf):
    """Bills written as workbooks with shared strings and number cells, read again."""
    cells = stage(exports.read_workbooks(s, fx.workbook_exports(s, sf), fx.work_folder(s)), fx.work_folder(s))
    return _imported(headers.map_headers(cells).or_fail(fx.work_folder(s)))


def q_workbook_amounts(s, sf):
    """Texts of the amount cells of workbooks: numbers exact to the cent get two decimals."""
    cells = stage(exports.read_workbooks(s, fx.workbook_exports(s, sf), fx.work_folder(s)), fx.work_folder(s))
    rows = headers.map_headers(cells).or_fail(fx.work_folder(s))
    return rows.select(ft.strip_ws("invoice_raw").alias("invoice"), F.col("amount_raw").alias("amount"))


def q_fixed_intake(s, sf):
    """Bills in workbooks of the fixed layout, with the cells that each bill came from."""
    cells = stage(exports.read_workbooks(s, fx.workbook_exports(s, sf, fixed=True), fx.work_folder(s)), fx.work_folder(s))
    rows = headers.map_headers(cells, mode="fixed").or_fail(fx.work_folder(s))
    return _imported(rows)


def q_csv_intake_words(s, sf):
    """By words, the first column of the second layout, ``Note``, is taken for its invoice."""
    cells = stage(exports.read_csv_exports(s, fx.csv_exports(s, sf)), fx.work_folder(s))
    return _imported(headers.map_headers(cells, mode="words").or_fail(fx.work_folder(s)))


def q_csv_intake_rejects(s, sf):
    """Exports of which some sheets and rows are refused: what is kept, and each reject."""
    cells = stage(exports.read_csv_exports(s, fx.faulty_exports(s, sf)), fx.work_folder(s))
    return _kept_and_refused(headers.map_headers(cells))


def q_csv_intake_settled(s, sf):
    """The same, written in quarantine by one pass over the exports' data."""
    cells = stage(exports.read_csv_exports(s, fx.faulty_exports(s, sf)), fx.work_folder(s))
    return _kept_and_refused(headers.map_headers(cells).settle(fx.work_folder(s), quarantine=True))


def _kept_and_refused(intake):
    file = F.regexp_extract("source_file", "file=([0-9]+)", 1).alias("file")
    kept_rows = intake.rows.select(
        file, "source_row", ft.strip_ws("invoice_raw").alias("invoice"), ft.amount_cents("amount_raw").alias("cents"),
    )
    refused = intake.rejects.select(file, "source_row", "reason")
    return kept_rows.unionByName(refused, allowMissingColumns=True)


def q_csv_intake_rows(s, sf):
    cells = stage(exports.read_csv_exports(s, fx.csv_exports(s, sf)), fx.work_folder(s))
    return _imported(headers.map_headers(cells).or_fail(fx.work_folder(s)))


def _imported(rows):
    """What an import has of each bill; the rows of its files are in no given order."""
    return rows.select(
        ft.strip_ws("invoice_raw").alias("invoice"), ft.strip_ws("merchant_raw").alias("merchant"),
        ft.amount_cents("amount_raw").alias("cents"),
        ft.bill_date("date_raw").cast("string").alias("bill_date"),
    )


def q_write_ledger(s, sf):
    """Ledger tables written and read again."""
    path = fx.work_folder(s)
    r = staged(s, sf)
    sinks.write_ledger(path, r, ch.build_changes(sinks.in_order(r)), dirty_rules(s), [sf], laid_out=True)
    return _flat(s.read.parquet(f"{path}/reconciliation"))


def q_verify_ledger(s, sf):
    """A written ledger, checked against the source rows."""
    path = fx.work_folder(s)
    r = staged(s, sf)
    sinks.write_ledger(path, r, ch.build_changes(sinks.in_order(r)), dirty_rules(s), [sf], laid_out=True)
    return sinks.verify_ledger(path, dirty_bills(s, sf))


def q_verify_ledger_damaged(s, sf):
    """A ledger with a cent too many in one record and without the changes of another."""
    path = fx.work_folder(s)
    cent = F.when(F.col("ord.source_row") == 20, 1).otherwise(0)
    r = staged(s, sf)
    changes = ch.build_changes(sinks.in_order(r)).filter("ord.source_row not in (20, 30)")
    sinks.write_ledger(
        path, r.withColumn("cents", F.col("cents") + cent), changes, dirty_rules(s), [sf], laid_out=True
    )
    return sinks.verify_ledger(path, dirty_bills(s, sf)).select("check", "ok")


def q_write_reports(s, sf):
    """The five report tables, written and read again: each of their rows."""
    path = fx.work_folder(s)
    r = staged(s, sf)
    by_ord = sinks.in_order(r)
    # what takes joins or totals to make is written before it is laid out, which reads it twice
    made = stage(review.reviewer_changes(r, fx.decision_log(s, sf)), fx.work_folder(s))
    log = ch.change_log(ch.build_changes(by_ord), sinks.in_order(made))
    sinks.write_reports(
        path,
        {
            "bills": reports.report_bills(sinks.in_month_order(r)),
            "needs_review": reports.report_needs_review(by_ord),
            "duplicates": reports.report_duplicates(by_ord), "change_log": reports.report_change_log(log),
            "summary": stage(reports.report_summary(r, HIGH_CENTS), fx.work_folder(s)),
        },
        laid_out=["bills", "needs_review", "duplicates", "change_log"],
    )

    def rows(name, cents, *label):
        label = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in label])
        return s.read.parquet(f"{path}/{name}").select(
            F.lit(name).alias("report"), label.alias("label"), cents.cast("bigint").alias("cents")
        )

    amount = F.col("amount") * 100
    return (
        rows("bills", amount, "month", "id", "reasons")
        .unionByName(rows("needs_review", amount, "id", "status", "date_raw", "amount_raw"))
        .unionByName(rows("duplicates", amount, "id", "duplicate_of"))
        .unionByName(rows("change_log", F.col("seq"), "id", "field", "before", "after", "rule"))
        .unionByName(rows("summary", F.col("cents"), "section", "place", "label", "rows", "note"))
    )


def q_decisions_round_trip(s, sf):
    """A decision log with damaged lines: the usable decisions and each refused line."""
    log = documents.read_decisions(s, fx.damaged_decisions(s, sf))
    good = log.rows.select("seq", "id", "row_id", "action", "after", "undo_of", F.col("at").cast("string").alias("made_at"))
    line = F.regexp_extract("line", '"seq":([0-9]+)', 1).cast("bigint").alias("seq")
    name = F.regexp_extract("line", '"id":"([^"]*)"', 1).alias("id")
    return good.unionByName(log.rejects.select(line, name, "copies", "reason"), allowMissingColumns=True)


def q_decision_gaps(s, sf):
    return documents.decision_gaps(fx.decision_log(s, sf))


def q_cache_round_trip(s, sf):
    """A cache written and read again, with damaged entries apart."""
    path = fx.work_folder(s)
    sinks.write_cache(path, fx.damaged_cache(s, sf))
    cache = documents.read_cache(s, path)
    bad = cache.rejects.withColumnRenamed("reason", "reject")
    return _flat(cache.rows.unionByName(bad, allowMissingColumns=True))


def q_write_suggestions(s, sf):
    path = fx.work_folder(s)
    report = suggest.suggestions_report(records(s, sf), fx.suggestion_cache(s, sf))
    sinks.write_suggestions(path, report)
    return s.read.schema(report.schema).json(path)


def all_queries() -> dict:
    return {n[2:]: f for n, f in globals().items() if n.startswith("q_")}
