"""Operators over dialogue tables: cleaning, reports, updates, pairing, prompts and responses."""

from __future__ import annotations

import time
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X
from .sampling import numbered

RECORD = "I string, S string, T string"
BATCH_RESULT = "batch long, id long, status string, attempts int, text string, errors array<string>"


def parse_records(raw: DataFrame, column: str = "value") -> DataFrame:
    """JSON records I, S, T as (raw_id, speaker, origin_text); missing keys are null."""
    r = raw.select(F.from_json(column, RECORD).alias("r"))
    return r.select(F.col("r.I").try_cast("long").alias("raw_id"), F.col("r.S").alias("speaker"), F.col("r.T").alias("origin_text"))


def cleaned(rows: DataFrame, text: str = "origin_text") -> DataFrame:
    """Rows whose text isn't removed by the cleaning rules: a plain filter, where the original deletes by id."""
    return rows.filter(X.removal_reason(F.col(text)).isNull())


def removal_report(rows: DataFrame) -> DataFrame:
    """``[ID: id] [reason] speaker: text`` for each row that cleaning removes; too_short carries the length."""
    reason = X.removal_reason(F.col("origin_text"))
    label = F.when(reason == "too_short", F.concat(F.lit("too_short("), F.char_length(X.strip(F.col("origin_text"))).cast("string"), F.lit(")"))).otherwise(reason)
    line = F.concat(F.lit("[ID: "), F.col("id").cast("string"), F.lit("] ["), label, F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(": "), F.coalesce("origin_text", F.lit("")))
    return rows.filter(reason.isNotNull()).select("id", line.alias("report"))


def removal_rate(rows: DataFrame, text: str = "origin_text") -> DataFrame:
    gone = X.removal_reason(F.col(text)).isNotNull()
    out = rows.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("remaining"))
    return out.withColumn("removed_percent", F.round(F.try_divide(100.0 * F.col("removed"), F.col("removed") + F.col("remaining")), 6))


def import_summary(rows: DataFrame) -> DataFrame:
    text = F.col("origin_text")
    return rows.agg(
        F.count("*").alias("rows_all"),
        F.count_distinct("speaker").alias("speakers"),
        F.count_if(F.col("para_text").isNull()).alias("pending"),
        F.count_if(text.isNull() | (text == "")).alias("empty_sql"),
        F.count_if(text.isNull() | (X.strip(text) == "")).alias("empty_stripped"),
    )


def duplicate_stats(rows: DataFrame, key: str) -> DataFrame:
    """How many keys occur more than once, and how many rows exceed one per key; a missing key counts as a key."""
    # hashes of keys are shuffled, not whole texts
    n = rows.groupBy(F.xxhash64(key), F.xxhash64(F.lit(1), key)).agg(F.count("*").alias("n"))
    return n.agg(F.count_if(F.col("n") > 1).alias("duplicated_keys"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"))


def similarity_stats(rows: DataFrame, by: str, score: str = "similarity") -> DataFrame:
    s = F.col(score)
    return rows.filter(s.isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(s), 6).alias("mean"), F.round(F.min(s), 6).alias("low"), F.round(F.max(s), 6).alias("high"))


def grams(text: str, n: int) -> list[str]:
    return [text[i : i + n] for i in range(len(text) - n + 1)]


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance in code points, a column of the table at a time as bits of one integer (Myers 1999, Hyyrö 2003)."""
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    places: dict[str, int] = {}
    for i, c in enumerate(long):
        places[c] = places.get(c, 0) | 1 << i
    every = (1 << len(long)) - 1
    more, less = every, 0
    for c in short:
        same = places.get(c, 0)
        kept = same | less
        free = (((same & more) + more) ^ more | same) & every
        up = less | every ^ (free | more)
        up, down = up << 1 | 1, (more & free) << 1
        more = (down | every ^ (kept | up) & every) & every
        less = up & kept & every
    return len(short) + more.bit_count() - less.bit_count()


def scored(a: str, b: str, n: int) -> tuple[float, float]:
    """Set similarity of n-grams, 1 if both texts are too short for any; edit similarity, 1 if both are empty."""
    x, y = set(grams(a, n)), set(grams(b, n))
    common, longest = len(x & y), max(len(a), len(b))
    union = len(x) + len(y) - common
    return common / union if union else 1.0, 1 - edit_distance(a, b) / longest if longest else 1.0


def pair_scores(a: Column, b: Column, n: int = 3) -> Column:
    """A struct (jaccard, edit) of two texts, null where either is null: text.jaccard and text.edit_similarity in one Arrow pass.

    The built-in levenshtein fills the whole table cell by cell; a column at a time as bits takes a tenth of that. A
    filter on the scores mustn't evaluate them again, so they count as nondeterministic.
    """

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if p is None or q is None else scored(p, q, n) for p, q in zip(x, y, strict=True)]
        return pd.DataFrame(rows, columns=["jaccard", "edit"], dtype=float)

    run.__annotations__ = {"x": pd.Series, "y": pd.Series, "return": pd.DataFrame}
    out = F.pandas_udf(run, "jaccard double, edit double").asNondeterministic()(a, b)
    return F.when(a.isNotNull() & b.isNotNull(), out)


def pair_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Mean of n-gram and edit similarity by ``pair_scores``; null where either side is null or blank."""
    blank = a.isNull() | b.isNull() | (X.strip(a) == "") | (X.strip(b) == "")
    return F.when(~blank, X.let(pair_scores(a, b, n), lambda s: (s["jaccard"] + s["edit"]) / 2))


def multiset_jaccard(pairs: DataFrame, n: int) -> DataFrame:
    """(id, score) of pairs (id, a, b): common n-grams with their counts over all; 1 if neither has any.

    Pairs are scored where they lie, a batch at a time; nothing is shuffled. A null text counts as empty.
    """

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        counts = [(Counter(grams(x or "", n)), Counter(grams(y or "", n))) for x, y in zip(a, b, strict=True)]
        both = [((x & y).total(), x.total() + y.total()) for x, y in counts]
        return pd.Series([c / (u - c) if u else 1.0 for c, u in both], dtype=float)

    return pairs.select("id", score("a", "b").alias("score"))


def line_pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Non-blank stripped lines of two texts, zipped to the shorter: columns line (from 1), a and b beside the row's own."""
    both = F.zip_with(X.solid_lines(F.col(a)), X.solid_lines(F.col(b)), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    zipped = F.filter(both, lambda p: p["a"].isNotNull() & p["b"].isNotNull())
    return rows.select(*rows.columns, F.posexplode(zipped).alias("at", "pair")).select(*rows.columns, (F.col("at") + 1).alias("line"), F.col("pair.a").alias("a"), F.col("pair.b").alias("b"))


def keyset_batch(rows: DataFrame, key: str, after: int, size: int) -> DataFrame:
    """The next ``size`` rows by key."""
    return rows.filter(F.col(key) > after).orderBy(key).limit(size)


def updated(rows: DataFrame, new: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` taken from ``new`` where it has a value for the key: a new version of the table."""
    fresh = new.select(F.col(key), F.col(column).alias("_new"))
    return rows.join(fresh, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def parsed_responses(batches: DataFrame) -> DataFrame:
    """``batches`` (speakers, response) with status and, if ok, the texts.

    Blank lines don't count. The first line that fails decides: a wrong number of lines is count_mismatch, a line
    that doesn't begin with its speaker and a full-width colon is speaker_mismatch, nothing after it empty_text.
    """
    lines = F.filter(F.split("response", "\n"), lambda x: X.strip(x) != "")
    rest = lambda line, who: X.strip(F.substring(line, F.char_length(who) + 2, F.lit(1_000_000_000)))
    state = F.zip_with(
        F.col("_lines"),
        F.col("speakers"),
        lambda line, who: F.when(~F.startswith(line, F.concat(who, F.lit("："))), "speaker_mismatch").when(rest(line, who) == "", "empty_text").otherwise("ok"),
    )
    bad = F.get(F.filter(state, lambda s: s != "ok"), F.lit(0))
    status = F.when(F.size("_lines") != F.size("speakers"), "count_mismatch").otherwise(F.coalesce(bad, F.lit("ok")))
    out = batches.withColumn("_lines", lines).withColumn("status", status)
    return out.withColumn("texts", F.when(F.col("status") == "ok", F.zip_with("_lines", "speakers", rest))).drop("_lines")


def pilot_report(runs: DataFrame, corpus_rows: int, batch_size: int, system_words: int = 0) -> DataFrame:
    """Of trial batches: how they went, and what ``corpus_rows`` rows would take.

    ``runs`` has success, lines, prompt_tokens, completion_tokens, elapsed, and of successful batches arrays of the
    original and new texts (origins, paras). Rates and means of rows are over successful batches; the cache rate is the
    share of the system prompt's words in those words and the characters sent.
    """
    ok = F.col("success")
    done = F.sum(F.when(ok, F.col("lines")).otherwise(0))
    size = lambda texts: F.aggregate(texts, F.lit(0), lambda n, x: n + F.char_length(x))
    pairs = F.zip_with("origins", "paras", lambda a, b: X.pair_similarity(a, b))
    scored = runs.withColumn("_sim", F.when(ok, F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x))).withColumn("_from", F.when(ok, size(F.col("origins")))).withColumn("_to", F.when(ok, size(F.col("paras"))))
    scale = lambda c: F.floor(F.try_divide(F.sum(F.when(ok, F.col(c))) * float(corpus_rows), done))
    seconds = F.avg(F.when(ok, F.col("elapsed")))
    return scored.agg(
        F.count("*").alias("batches"),
        F.round(F.try_divide(done * 1.0, F.sum("lines")), 6).alias("success_rate"),
        F.round(F.try_divide(F.sum("_sim"), done), 6).alias("mean_similarity"),
        F.round(F.try_divide((F.sum("_to") - F.sum("_from")) * 100.0, F.sum("_from")), 6).alias("length_change"),
        scale("prompt_tokens").alias("input_tokens_for_all"),
        scale("completion_tokens").alias("output_tokens_for_all"),
        F.round(F.try_divide(F.lit(100.0 * system_words), F.sum("_from") + system_words), 6).alias("cache_rate"),
        F.round(seconds, 6).alias("seconds_per_batch"),
        F.round(seconds * -(-corpus_rows // batch_size), 4).alias("seconds_for_all"),
    )


def previewed(rows: DataFrame, batch_size: int, batches: int = 3, lines: int = 3) -> DataFrame:
    """(batch, records, first_id, last_id, shown) of the first batches of pending rows (id, speaker, origin_text), and their first prompt lines.

    Nothing is sent. The number of batches and lines is the operator's limit.
    """
    head = rows.orderBy("id").limit(batches * batch_size)
    batch = (F.floor((F.row_number().over(W.orderBy("id")) - 1) / batch_size) + 1).alias("batch")
    listed = head.select("id", X.prompt_line(F.col("speaker"), F.col("origin_text")).alias("line"), batch)
    grouped = listed.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("id", "line"))).alias("r"))
    return grouped.select("batch", F.size("r").alias("records"), F.col("r.id")[0].alias("first_id"), F.element_at("r.id", -1).alias("last_id"), F.slice("r.line", 1, lines).alias("shown"))


def spread_sample(rows: DataFrame, batch: str, order: Column, total: int) -> DataFrame:
    """At most ``total`` rows, the first ceil(total / batches) of each batch."""
    n = rows.select(batch).distinct().count()
    each = -(-total // max(n, 1))
    turn = F.row_number().over(W.partitionBy(batch).orderBy(order))
    return rows.withColumn("_turn", turn).filter(F.col("_turn") <= each).orderBy(batch, "_turn").limit(total).drop("_turn")


def paraphrased(rows: DataFrame, client, batch_size: int = 75, retries: int = 3, delay: float = 0.0, concurrency: int | None = None) -> DataFrame:
    """One row per dialogue (batch, id, status, attempts, text, errors), through an injected client.

    Rows with a blank speaker or no text never reach the client: their status is ``unusable``. Others go in batches of
    ``batch_size`` in the order of ids, each tried up to ``retries`` times: after a response that doesn't parse with the
    strict prompt, after ``delay`` seconds; after ``RateLimited`` after ``delay`` times the number of the attempt; after
    any other error after ``delay``. ``errors`` are the responses that failed, as "attempt: reason: response" (the
    dead-letter log). ``client`` has ``paraphrase(lines, strict) -> str`` and may raise; it is pickled to the tasks.
    At most ``concurrency`` batches are with the client at a time, if that is given: so many tasks there are.
    """
    line = X.prompt_line(F.col("speaker"), F.col("origin_text"))
    keyed = rows.select("id", "speaker", line.alias("line")).withColumn("usable", F.col("line").isNotNull())
    # numbered apart, so that batches are full whatever the ids and the unusable rows
    turned = numbered(keyed, [F.asc("id")], "usable").select("*", F.floor((F.col("number") - 1) / batch_size).alias("batch"))

    def attempt(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        status, texts, tries, strict, errors = "unusable", [None] * len(pdf), 0, False, []
        while key[0] and tries < retries and status != "ok":
            tries += 1
            if tries > 1:
                time.sleep(wait)
            wait = delay
            try:
                answer = client.paraphrase(pdf["line"].tolist(), strict)
            except RateLimited:
                status, wait = "error: RateLimited", delay * tries
            except Exception as e:
                status = f"error: {type(e).__name__}"
            else:
                status, got = client_lines(answer, pdf["speaker"].tolist())
                texts = got if status == "ok" else texts
                if status != "ok":
                    strict = True
                    errors.append(f"{tries}: {status}: {answer}")
        out = pdf[["batch", "id"]].copy()
        out["status"], out["attempts"], out["text"] = status, tries, texts
        out["errors"] = [errors] * len(out)
        return out.astype({"attempts": "int32"})

    dealt = turned if concurrency is None else turned.repartition(concurrency, "usable", "batch")
    return dealt.groupBy("usable", "batch").applyInPandas(attempt, BATCH_RESULT)


class RateLimited(Exception):
    """Raised by a client whose service asks to slow down."""


def client_lines(answer: str, speakers: list[str]) -> tuple[str, list[str]]:
    """Status and texts of one response; the rules of ``parsed_responses``, where a task must decide on a retry."""
    lines = [line for line in answer.split("\n") if line.strip()]
    said = [line.removeprefix(f"{who.strip()}：").strip() if line.startswith(f"{who.strip()}：") else None for line, who in zip(lines, speakers, strict=False)]
    states = ["count_mismatch"] if len(lines) != len(speakers) else ["speaker_mismatch" if text is None else "ok" if text else "empty_text" for text in said]
    status = next((s for s in states if s != "ok"), "ok")
    return status, said if status == "ok" else []
