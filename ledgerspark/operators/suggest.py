"""Advisory category suggestions.

Suggestions never change a record.  Work is done once per distinct merchant; a suggestion
function is called on executors in small batches, and replies are read with a small Arrow UDF
that only finds the JSON in the text.
"""

import datetime as dt
import hashlib
import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerspark import schema as S
from ledgerspark.functions.reasons import keyword_guess, keyword_reason
from ledgerspark.functions.text import norm_key
from ledgerspark.operators.numbering import number_rows
from ledgerspark.operators.skew import fits_broadcast, lookup_join
from ledgerspark.sinks.staging import file_system

NO_CACHE = "no cached model output for this merchant"
NO_ANSWER = "no answer from the model"
REASON_CHARS = 140
ENTRY = ["norm_key", "merchant", "category", "confidence", "reason"]


def uncategorised_merchants(records: DataFrame) -> DataFrame:
    """Distinct merchants without a category, sorted."""
    return (
        records.filter(F.col("category") == S.UNCATEGORISED)
        .select("merchant").distinct().orderBy("merchant")
    )


def _open_unmapped(records: DataFrame) -> DataFrame:
    rows = records.filter(F.array_contains("reasons", S.R_UNMAPPED))
    return rows.filter(F.col("decided").isNull()) if "decided" in records.columns else rows


def _lookup(rows: DataFrame, cache: DataFrame, spread: str) -> DataFrame:
    table = cache.select(
        "norm_key", F.col("category").alias("suggested"), "confidence",
        F.col("reason").alias("why"), "provider", "model", "generated",
        F.lit(True).alias("cached"),
    )
    bound = 0 if fits_broadcast(cache) else None
    keyed = rows.withColumn("norm_key", norm_key("merchant"))
    return lookup_join(keyed, table, ["norm_key"], spread, bound)


def attach_suggestions(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Undecided rows without a category, each with its cached suggestion or a note."""
    rows = _open_unmapped(records).select("id", "merchant", "cents")
    return _lookup(rows, cache, "id").select(
        "id", "merchant", F.col("suggested").alias("category"), "confidence",
        F.when(F.col("cached"), F.coalesce("why", F.lit(""))).otherwise(NO_CACHE).alias("reason"),
        "model",
    )


def keyword_suggestions(records: DataFrame) -> DataFrame:
    """Offline suggestions from merchant names, for undecided rows without a category."""
    return _open_unmapped(records).select(
        "id", "merchant", keyword_guess("merchant").alias("category"),
        keyword_reason("merchant").alias("reason"),
    )


def missing_suggestions(merchants: DataFrame, cache: DataFrame) -> DataFrame:
    """Merchants the cache does not cover, one per comparison key."""
    return (
        merchants.withColumn("norm_key", norm_key("merchant"))
        .join(cache.select("norm_key"), "norm_key", "left_anti")
        .groupBy("norm_key")
        .agg(F.max("merchant").alias("merchant"))
    )


def suggestions_report(records: DataFrame, cache: DataFrame) -> DataFrame:
    """Every uncategorised merchant with its cached entry, or nulls."""
    names = records.filter(F.col("category") == S.UNCATEGORISED).select("merchant").distinct()
    return _lookup(names, cache, "merchant").select(
        "merchant", F.col("suggested").alias("category"), "confidence",
        F.col("why").alias("reason"), F.coalesce("cached", F.lit(False)).alias("cached"),
    )


def allowed_category(c: Column) -> Column:
    return F.when(c.isin(S.CATEGORIES), c)


def allowed_confidence(c: Column) -> Column:
    return F.when(c.between(0.0, 1.0), c)


# --- asking and reading replies -----------------------------------------------------------

_FENCE = re.compile(r"```(?:json)?")
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[\[\]]', re.S)
_DECODER = json.JSONDecoder()
NO_ARRAY = "no JSON array in the model reply"
TOO_DEEP = "the JSON array in the model reply is nested too deeply"
CUT_OFF = "the model reply opens a JSON array and never closes it"


def _closes(text: str, start: int) -> bool:
    """Whether the bracket at ``start`` is closed again, not counting brackets in strings."""
    depth = 0
    for token in _TOKEN.finditer(text, start):
        if token[0] in "[]":
            depth += 1 if token[0] == "[" else -1
            if depth == 0:
                return True
    return False


def first_array(reply: str) -> tuple[list | None, str | None]:
    """First JSON array in a reply, ignoring code fences and prose; or why there is none."""
    text = _FENCE.sub("", reply)
    cut_off = False
    for bracket in re.finditer(r"\[", text):
        try:
            return _DECODER.raw_decode(text, bracket.start())[0], None
        except RecursionError:
            return None, TOO_DEEP
        except ValueError:
            cut_off = cut_off or not _closes(text, bracket.start())
    return None, CUT_OFF if cut_off else NO_ARRAY


def _number(value) -> float | None:
    """A number as float; one that no float can hold is none."""
    try:
        return float(value) if isinstance(value, (int, float)) else None
    except OverflowError:
        return None


def _entry(item) -> dict | None:
    """Text fields of one answer, or None when it names no merchant."""
    if not isinstance(item, dict) or not isinstance(item.get("merchant"), str):
        return None
    confidence, category = item.get("confidence"), item.get("category")
    return {
        "merchant": item["merchant"],
        "category": category if isinstance(category, str) else None,
        "confidence": _number(confidence),
        "reason": str(item.get("reason", "")),
    }


_ANSWERS = T.StructType(
    [
        T.StructField(
            "entries",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("merchant", T.StringType()),
                        T.StructField("category", T.StringType()),
                        T.StructField("confidence", T.DoubleType()),
                        T.StructField("reason", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(_ANSWERS)
def read_reply(replies: pd.Series) -> pd.DataFrame:
    entries, errors = [], []
    for reply in replies:
        items, error = first_array(reply or "")
        found = [_entry(i) for i in items or []]
        entries.append([e for e in found if e])
        errors.append(error)
    return pd.DataFrame({"entries": entries, "error": errors})


def ingest_replies(replies: DataFrame) -> DataFrame:
    """Entries found in reply texts ``(batch_id, reply)``.

    A reply without a usable array gives one row with ``error``.  A category outside the allowed
    set and a confidence outside 0..1 become null; reasons keep their first 140 characters.
    """
    read = replies.withColumn("r", read_reply("reply"))
    rows = read.select("batch_id", "r.error", F.posexplode_outer("r.entries").alias("pos", "e"))
    return rows.filter(F.col("e").isNotNull() | F.col("error").isNotNull()).select(
        "batch_id",
        "pos",
        norm_key(F.col("e.merchant")).alias("norm_key"),
        F.col("e.merchant").alias("merchant"),
        allowed_category(F.col("e.category")).alias("category"),
        allowed_confidence(F.col("e.confidence")).alias("confidence"),
        F.substring("e.reason", 1, REASON_CHARS).alias("reason"),
        "error",
    )


def latest_answers(entries: DataFrame) -> DataFrame:
    """One entry per merchant key: the last one given."""
    rest = [c for c in ENTRY if c != "norm_key"]
    return (
        entries.filter(F.col("merchant").isNotNull())
        .withColumn("norm_key", norm_key("merchant"))
        .groupBy("norm_key")
        .agg(F.max(F.struct("batch_id", "pos", *rest)).alias("e"))
        .select("norm_key", *[f"e.{c}" for c in rest])
    )


def suggestion_batches(merchants: DataFrame, batch: int = S.SUGGESTION_BATCH) -> DataFrame:
    """Calls ``(batch_id, merchants)``: the names in order, ``batch`` per call.

    The calls depend on the names alone, not on how they are spread over tasks.
    """
    names = merchants.select("merchant").filter("merchant is not null").distinct()
    numbered = number_rows(names, [], order=["merchant"])
    calls = numbered.withColumn("batch_id", F.floor((F.col("n") - 1) / batch))
    # a list holds at most one batch
    return calls.groupBy("batch_id").agg(F.sort_array(F.collect_list("merchant")).alias("merchants"))


def _reply_file(log: str, names: list[str]) -> tuple[pafs.FileSystem, str, str]:
    where, folder = file_system(log.rstrip("/"))
    return where, folder, hashlib.sha256(json.dumps(names).encode()).hexdigest() + ".txt"


def _logged_reply(log: str, names: list[str]) -> str | None:
    """The reply that an earlier run or attempt got to exactly these names."""
    where, folder, name = _reply_file(log, names)
    path = f"{folder}/{name}"
    if where.get_file_info(path).type != pafs.FileType.File:
        return None
    with where.open_input_stream(path) as file:
        return file.read().decode("utf-8", "surrogatepass")


def _log_reply(log: str, names: list[str], reply: str) -> None:
    where, folder, name = _reply_file(log, names)
    where.create_dir(folder, recursive=True)
    part = f"{folder}/_{uuid.uuid4().hex}"
    with where.open_output_stream(part) as file:
        file.write(reply.encode("utf-8", "surrogatepass"))
    # no reader sees half of a reply
    where.move(part, f"{folder}/{name}")


def suggest(
    merchants: DataFrame,
    suggest_fn: Callable[[list[str]], str],
    batch: int = S.SUGGESTION_BATCH,
    log: str | None = None,
) -> DataFrame:
    """Ask ``suggest_fn`` about every merchant, ``batch`` names per call, on the executors.

    The function gets a list of names and returns the reply text.  A failing call leaves its
    names without an answer and records the error; it never stops the job.  One row per
    distinct merchant: ``(norm_key, merchant, category, confidence, reason, error)``.

    ``log`` is a folder that all machines share.  Replies are kept there per call, so a retried
    task, a second action on the result or a later run only asks what has no reply yet; failed
    calls are not kept.
    """

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for names in map(list, frame["merchants"]):
                reply, error = _logged_reply(log, names) if log else None, None
                if reply is None:
                    try:
                        reply = suggest_fn(names)
                    except Exception as failure:  # the user's function may raise anything
                        error = f"{type(failure).__name__}: {failure}"
                    else:
                        if log:
                            _log_reply(log, names, reply)
                yield pd.DataFrame({"merchants": [names], "reply": [reply], "failed": [error]})

    calls = suggestion_batches(merchants, batch).select("merchants").mapInPandas(
        ask, "merchants array<string>, reply string, failed string"
    )
    read = calls.withColumn("r", read_reply("reply"))
    error = F.coalesce("failed", "r.error")
    asked = read.select(
        F.explode("merchants").alias("merchant"), "r.entries", error.alias("error")
    ).withColumn("norm_key", norm_key("merchant"))
    mine = F.filter("entries", lambda e: norm_key(e["merchant"]) == F.col("norm_key"))
    return asked.withColumn("e", F.try_element_at(mine, F.lit(-1))).select(
        "norm_key",
        "merchant",
        allowed_category(F.col("e.category")).alias("category"),
        allowed_confidence(F.col("e.confidence")).alias("confidence"),
        F.coalesce(F.substring("e.reason", 1, REASON_CHARS), F.lit(NO_ANSWER)).alias("reason"),
        "error",
    )


def upsert_cache(
    cache: DataFrame,
    merchants: DataFrame,
    answers: DataFrame,
    provider: str,
    model: str,
    generated: dt.date,
) -> DataFrame:
    """Cache plus an entry for every asked merchant it lacked; existing entries win.

    ``answers`` has one row per ``norm_key``.  A merchant without an answer gets an explicit
    empty entry, so it is not asked again.
    """
    new = missing_suggestions(merchants, cache).join(
        answers.select("norm_key", "category", "confidence", "reason"), "norm_key", "left"
    )
    rows = new.select(
        "norm_key", "merchant", "category", "confidence",
        F.coalesce("reason", F.lit(NO_ANSWER)).alias("reason"),
        F.lit(provider).alias("provider"), F.lit(model).alias("model"),
        F.lit(generated).alias("generated"),
    )
    return cache.unionByName(rows)


# --- evaluation ----------------------------------------------------------------------------


def _scored(labelled: DataFrame, predictions: DataFrame) -> DataFrame:
    keyed = labelled.withColumn("norm_key", norm_key("merchant"))
    found = predictions.select(
        "norm_key", F.col("category").alias("predicted"), F.lit(True).alias("covered")
    )
    return keyed.join(found, "norm_key", "left").withColumn(
        "hit", F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False))
    )


def keyword_predictions(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        norm_key("merchant").alias("norm_key"), keyword_guess("merchant").alias("category")
    ).distinct()


def eval_suggestions(
    labelled: DataFrame, predictions: DataFrame, pass_threshold: float = 0.8
) -> DataFrame:
    """Hits per kind and overall (``kind = 'all'``) with a verdict: pass, fail or not run.

    The evaluation only counts as run when every labelled merchant has a prediction entry.
    """
    scores = (
        _scored(labelled, predictions)
        .rollup("kind")
        .agg(
            F.count("*").alias("items"),
            F.count_if("covered").alias("covered"),
            F.count_if("hit").alias("hits"),
            F.grouping("kind").alias("g"),
        )
    )
    accuracy = F.try_divide(F.col("hits").cast("double"), F.col("items").cast("double"))
    return scores.select(
        F.when(F.col("g") == 1, "all").otherwise(F.col("kind")).alias("kind"),
        "items",
        "covered",
        "hits",
        F.round(accuracy, 4).alias("accuracy"),
        F.when(
            F.col("g") == 1,
            F.when(F.col("covered") < F.col("items"), "not run")
            .when(accuracy >= pass_threshold, "pass")
            .otherwise("fail"),
        ).alias("verdict"),
    )


def eval_misses(labelled: DataFrame, predictions: DataFrame) -> DataFrame:
    """Labelled merchants whose prediction differs."""
    return (
        _scored(labelled, predictions).filter(~F.col("hit"))
        .select("merchant", "kind", "expected", "predicted")
    )
