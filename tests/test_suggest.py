import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerspark.operators import checks as ck
from ledgerspark.operators import rules, suggest
from ledgerspark.plans.clean import clean
from ledgerspark.sources import documents
from tests import sample

# fixed values, the published evaluation set: merchant, expected category, kind
LABELLED = [
    ("Northwind Office Supplies", "Supplies", "keyword"),
    ("Paperclip Stationers Ltd", "Supplies", "keyword"),
    ("Harbour Packaging Supply", "Supplies", "keyword"),
    ("Quill & Ledger Stationers", "Supplies", "keyword"),
    ("Maple Hydro Utility", "Utilities", "keyword"),
    ("Lakeshore Water Services", "Utilities", "keyword"),
    ("Bluehill Fibre Internet", "Utilities", "keyword"),
    ("Prairie Gas Co-op", "Utilities", "keyword"),
    ("Orbit Cloud Software", "Software", "keyword"),
    ("Ledgerline SaaS", "Software", "keyword"),
    ("Nimbus Hosting Inc", "Software", "keyword"),
    ("Redwood App Licensing", "Software", "keyword"),
    ("Granite Property Lease", "Rent", "keyword"),
    ("Eastgate Landlord Trust", "Rent", "keyword"),
    ("Harbourview Realty Rent", "Rent", "keyword"),
    ("Summit Plaza Leasing", "Rent", "keyword"),
    ("Kestrel Freight Co", "Transport", "keyword"),
    ("Cedar Courier Express", "Transport", "keyword"),
    ("Northern Haulage Logistics", "Transport", "keyword"),
    ("Bayline Shipping", "Transport", "keyword"),
    ("Inkwell & Binder", "Supplies", "inference"),
    ("Toner Depot", "Supplies", "inference"),
    ("Lumen Grid Co", "Utilities", "inference"),
    ("Aquaflow Municipal Billing", "Utilities", "inference"),
    ("Bytecraft Studio", "Software", "inference"),
    ("Kernel Forge Labs", "Software", "inference"),
    ("Unit 4B Occupancy", "Rent", "inference"),
    ("Brickstone Premises", "Rent", "inference"),
    ("Pallet & Axle", "Transport", "inference"),
    ("Last Mile Runners", "Transport", "inference"),
]


def labelled(spark):
    return spark.createDataFrame(LABELLED, "merchant string, expected string, kind string")


def cache_document(tmp_path, **changes):
    entries = {
        suggest_key(m): {"merchant": m, "category": c, "confidence": 0.9, "reason": "known"}
        for m, c, _ in LABELLED
    }
    entries["demoother06"] = {"merchant": "Demo Other 06", "category": None, "confidence": 0.95}
    document = {"provider": "anthropic", "model": "m", "generated": "2026-09-22", "entries": entries}
    document.update(changes)
    path = tmp_path / "cache.json"
    path.write_text(json.dumps(document))
    return str(path)


def suggest_key(name):
    return "".join(c for c in name.lower() if c.isascii() and c.isalnum())


def scores(df):
    return {r["kind"]: (r["hits"], r["items"], r["verdict"]) for r in df.collect()}


def test_keyword_baseline(spark):
    out = suggest.eval_suggestions(labelled(spark), suggest.keyword_predictions(labelled(spark)))
    assert scores(out) == {
        "keyword": (19, 20, None), "inference": (0, 10, None), "all": (19, 30, "fail"),
    }


def test_cached_answers(spark, tmp_path):
    cache = documents.load_suggestion_cache(spark, cache_document(tmp_path))
    out = suggest.eval_suggestions(labelled(spark), cache)
    assert scores(out)["all"] == (30, 30, "pass")
    partial = cache.filter(F.col("norm_key") != "tonerdepot")
    assert scores(suggest.eval_suggestions(labelled(spark), partial))["all"][2] == "not run"
    assert [r["merchant"] for r in suggest.eval_misses(labelled(spark), partial).collect()] == [
        "Toner Depot"
    ]


@pytest.mark.parametrize(
    "damage",
    [
        {"entries": {"x": {"merchant": "X", "category": "Pets", "confidence": 0.5}}},
        {"entries": {"x": {"merchant": "Y", "category": "Rent", "confidence": 0.5}}},
        {"entries": {"x": {"merchant": "X", "category": "Rent", "confidence": 1.5}}},
        {"provider": "nobody"}, {"model": None}, {"generated": None},
    ],
)
def test_bad_cache_is_refused(spark, tmp_path, damage):
    with pytest.raises(ValueError, match="well formed"):
        documents.load_suggestion_cache(spark, cache_document(tmp_path, **damage))


REPLIES = [
    ('My answer:\n```json\n[{"merchant": "Oak [1]"}]\n```\nBye', [{"merchant": "Oak [1]"}], None),
    ('per [rule 3]: [{"merchant": "the \\"Inn\\" ]["}]', [{"merchant": 'the "Inn" ]['}], None),
    ('{"answers": [{"merchant": "Elm"}], "n": 1}', [{"merchant": "Elm"}], None),
    ('first [10, 20] and then [30]', [10, 20], None),
    ('```[[1], "x"]```', [[1], "x"], None),
    ("Sorry, no answer.", None, suggest.NO_ARRAY),
    ("The list [to be decided] is empty.", None, suggest.NO_ARRAY),
    ("[a] [b] [c, d]", None, suggest.NO_ARRAY),
    ("So far: [1, 2,", None, suggest.CUT_OFF),
    ('[{"merchant": "Elm", "category": "Rent"}, {"merchant": "As', None, suggest.CUT_OFF),
    ("", None, suggest.NO_ARRAY),
]


@pytest.mark.parametrize("reply,items,error", REPLIES)
def test_first_array(reply, items, error):
    assert suggest.first_array(reply) == (items, error)


def test_ingest_replies(spark):
    answers = [
        {"merchant": "A", "category": "Rent", "confidence": 0.5, "reason": "x" * 200},
        {"merchant": "B", "category": "Pets", "confidence": 7, "reason": None},
        {"merchant": 5, "category": "Rent"}, "text", None, {"category": "Rent"},
        {"merchant": "a!", "category": None, "confidence": "high"},
    ]
    replies = spark.createDataFrame(
        [(1, json.dumps(answers)), (2, "no"), (3, "[]")], "batch_id bigint, reply string"
    )
    out = suggest.ingest_replies(replies)
    got = {(r["batch_id"], r["merchant"]): r for r in out.collect()}
    assert set(got) == {(1, "A"), (1, "B"), (1, "a!"), (2, None)}
    assert got[1, "A"]["category"] == "Rent" and len(got[1, "A"]["reason"]) == 140
    assert got[1, "B"]["category"] is None and got[1, "B"]["confidence"] is None
    assert got[2, None]["error"] == suggest.NO_ARRAY
    last = {r["norm_key"]: r["merchant"] for r in suggest.latest_answers(out).collect()}
    assert last == {"a": "a!", "b": "B"}


def _model(names):
    if "M13" in names:
        raise TimeoutError("slow")
    return "Sure: " + json.dumps(
        [{"merchant": n.upper(), "category": "Rent", "confidence": 1, "reason": str(len(names))}
         for n in names if n != "M2"]
    )


def test_suggest_in_batches(spark):
    names = spark.createDataFrame([(f"m{i}",) for i in range(13)] + [("M13",)], "merchant string")
    out = suggest.suggest(names.coalesce(1).orderBy("merchant").coalesce(1), _model).collect()
    assert len(out) == 14
    failed = [r for r in out if r["error"]]
    assert all(r["category"] is None and r["error"] == "TimeoutError: slow" for r in failed)
    assert {r["reason"] for r in out if not r["error"]} <= {"12", "2"}


def test_cache_grows_and_ledger_stays(spark, tmp_path):
    records = clean(sample.source_rows(spark), rules.builtin_rules(spark), hot=[]).cache()
    cache = documents.load_suggestion_cache(spark, cache_document(tmp_path))
    report = suggest.suggestions_report(records, cache)
    got = {r["merchant"]: (r["category"], r["cached"]) for r in report.collect()}
    assert got == {"=SYNTHETIC_FORMULA_TEXT()": (None, False), "Demo Other 06": (None, True)}
    names = suggest.uncategorised_merchants(records)
    assert [r["norm_key"] for r in suggest.missing_suggestions(names, cache).collect()] == [
        "syntheticformulatext"
    ]
    none = cache.limit(0).select("norm_key", "category", "confidence", "reason")
    grown = suggest.upsert_cache(cache, names, none, "openai", "m2", dt.date(2026, 10, 1))
    new = grown.filter("norm_key = 'syntheticformulatext'").first()
    assert (new["category"], new["reason"], new["model"]) == (None, suggest.NO_ANSWER, "m2")
    assert suggest.missing_suggestions(names, grown).count() == 0
    assert ck.check_cache(grown).first()["ok"]
    report = suggest.suggestions_report(records, grown)
    assert ck.check_advisory(report, grown, records).first()["ok"]
    wrong = records.withColumn("category", F.lit("Rent"))
    assert not ck.check_advisory(report, grown, wrong).first()["ok"]
    rows = suggest.attach_suggestions(records, cache)
    assert rows.count() == 20
    assert rows.filter(F.col("reason") == suggest.NO_CACHE).count() == 1
    assert suggest.keyword_suggestions(records).count() == 20


def test_failed_call_is_asked_again_alone(spark, tmp_path):
    asked = tmp_path / "asked"
    asked.mkdir()

    def model(names):
        calls = len(list(asked.iterdir()))
        (asked / str(calls)).write_text("\n".join(names))
        if "n13" in names and calls < 3:
            raise TimeoutError("slow")
        return json.dumps([{"merchant": n, "category": "Rent", "confidence": 1, "reason": ""} for n in names])

    # 30 names in order are three calls, whatever their partitions
    names = spark.createDataFrame([(f"n{i:02}",) for i in range(30)], "merchant string").repartition(5)
    log = str(tmp_path / "log")
    first = suggest.suggest(names.coalesce(1), model, log=log).collect()
    assert sorted(r["merchant"] for r in first if r["error"]) == [f"n{i:02}" for i in range(12, 24)]
    n_first = len(list(asked.iterdir()))
    second = suggest.suggest(names, model, log=log).collect()
    assert [r for r in second if r["error"]] == [] and len(second) == 30
    later = [f.read_text().split("\n")[0] for f in asked.iterdir() if int(f.name) >= n_first]
    assert set(later) == {"n12"}
    assert suggest.suggest(names.limit(0), model, log=log).count() == 0


def test_calls_depend_on_names_alone(spark):
    names = spark.createDataFrame([(f"n{i % 20:02}",) for i in range(60)] + [(None,)], "merchant string")
    calls = {r["batch_id"]: r["merchants"] for r in suggest.suggestion_batches(names.repartition(7), 12).collect()}
    assert calls == {0: [f"n{i:02}" for i in range(12)], 1: [f"n{i:02}" for i in range(12, 20)]}


def test_damaged_cache_entries(spark, tmp_path):
    cache = documents.load_suggestion_cache(spark, cache_document(tmp_path))
    bad = cache.limit(1).withColumn("provider", F.lit(None).cast("string"))
    cache.unionByName(bad).write.parquet(str(tmp_path / "table"))
    read = documents.read_cache(spark, str(tmp_path / "table"))
    assert read.rows.count() == cache.count()
    assert [r["reason"] for r in read.rejects.collect()] == ["unknown provider"]
