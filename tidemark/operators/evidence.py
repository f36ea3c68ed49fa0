"""Evidence sentences for disputed figures, and checking recorded answers against them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import fixed_values as fv
from tidemark.functions import amounts as am
from tidemark.functions.text import SCRIPT_OR_STYLE, TAG, squeeze_spaces, unescape_entities

c = F.col


def names_metric(text: Column, metric: Column) -> Column:
    low = F.lower(text)
    per = [F.when(metric == k, reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words]))
           for k, words in fv.EVIDENCE_WORDS.items()]
    return F.coalesce(*per, F.lit(False))


def evidence_sentences(docs: DataFrame, keys: list[str], text: str, metric: str, limit: int = fv.EVIDENCE_LIMIT, order: str | None = None) -> DataFrame:
    """Sentences that state a unit and name the metric, in order, up to the budget of bytes.

    Sentences with a run of bare numbers are tables in disguise and are left out. The budget is part of the result: reading stops at
    the first sentence that would exceed it. With ``order`` a key has several documents, read in that order under one budget; a
    document's sentences are summed in themselves and the sums of the documents before are carried over.
    """
    sentence = F.regexp_replace(c("_s"), r"^\s+|\s+$", "")
    at = (c(order) if order else F.lit(0)).alias("_at")
    rows = (docs.select(*keys, c(metric).alias("metric"), at, F.posexplode(F.split(c(text), fv.SENTENCE_END)).alias("position", "_s"))
            .withColumn("sentence", sentence)
            .where((c("sentence") != "") & c("sentence").rlike(fv.EXPLICIT_UNIT) & ~c("sentence").rlike(fv.BARE_NUMBER_RUN))
            .where(names_metric(c("sentence"), c("metric"))))
    key = [*keys, "metric"]
    inside = F.sum(F.octet_length("sentence")).over(W.partitionBy(*key, "_at").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow))
    rows = rows.withColumn("chars", inside)
    if order:
        sums = rows.groupBy(*key, "_at").agg(F.max("chars").alias("_k"))
        before = F.sum("_k").over(W.partitionBy(*key).orderBy("_at").rowsBetween(W.unboundedPreceding, -1))
        rows = rows.join(sums.select(*key, "_at", F.coalesce(before, F.lit(0)).alias("_before")), [*key, "_at"]).withColumn("chars", c("chars") + c("_before"))
    return rows.where(c("chars") <= limit).select(*key, *([c("_at").alias(order)] if order else []), "position", "sentence", "chars")


def exhibit_texts(exhibits: DataFrame, keys: list[str]) -> DataFrame:
    """Running text of the press exhibits among a filing's files (keys, file_name, html), with ``exhibit``, their order.

    Names with ex99 that end in .htm come first, by name, then those with EX99. Scripts, styles and tags are taken out, character
    references resolved twice (the files quote markup), white space squeezed.
    """
    name = c("file_name")
    group = F.when(name.rlike(r"ex99.*\.htm$"), 0).when(name.rlike(r"EX99.*\.htm$"), 1)
    bare = F.regexp_replace(F.regexp_replace(c("html"), SCRIPT_OR_STYLE, ""), TAG, "")
    text = unescape_entities(squeeze_spaces(unescape_entities(bare)))
    return exhibits.where(group.isNotNull()).select(*keys, F.struct(group.alias("group"), name.alias("file_name")).alias("exhibit"), text.alias("text"))


def gather_evidence(exhibits: DataFrame, wanted: DataFrame, keys: list[str], limit: int = fv.EVIDENCE_LIMIT) -> DataFrame:
    """Evidence for each wanted (keys, metric): its sentences over all press exhibits of the filing under one budget, as one text."""
    texts = exhibit_texts(exhibits, keys).join(wanted.select(*keys, "metric").distinct(), keys)
    rows = evidence_sentences(texts, keys, "text", "metric", limit, "exhibit")
    parts = F.array_sort(F.collect_list(F.struct("exhibit", "position", "sentence")))  # at most the budget
    return rows.groupBy(*keys, "metric").agg(F.transform(parts, lambda x: F.concat(x["sentence"], F.lit("."))).alias("_s"), F.max("chars").alias("chars")).select(
        *keys, "metric", F.array_join("_s", " ").alias("evidence"), F.size("_s").alias("sentences"), "chars")


def adjudication_candidates(lines: DataFrame) -> DataFrame:
    """The two readings a mis-tagged money figure can have: as tagged, and in thousands."""
    one = lambda i, v, basis: F.struct(F.lit(i).alias("id"), v.alias("value"), F.lit(basis).alias("unit_basis"))
    return lines.where((c("confidence") == fv.SUSPECT) & (c("metric_unit") == fv.USD)).withColumn(
        "candidates", F.array(one("A", c("value"), "as_tagged_usd"), one("B", c("value") * 1000, "assumed_thousands")))


def answer_problem(candidates: Column, evidence: Column, choice: Column, value: Column, quote: Column, confidence: Column) -> Column:
    """Why a recorded answer cannot be used; NULL when it can."""
    chosen = F.get(F.filter(candidates, lambda x: x["id"] == choice), F.lit(0))
    q = squeeze_spaces(F.coalesce(quote, F.lit("")))
    return (F.when(F.lower(choice) == "none", F.lit("declined"))
            .when(chosen.isNull(), F.lit("unknown_choice"))
            .when(F.abs(chosen["value"] - value) > 1e-9, F.lit("value_mismatch"))
            .when((q == "") | ~F.contains(squeeze_spaces(evidence), q), F.lit("quote_not_found"))
            .when(F.lower(confidence) == "low", F.lit("low_confidence")))


def apply_answers(lines: DataFrame, exhibits: DataFrame, answers: DataFrame) -> DataFrame:
    """Lines after recorded answers: suspect money lines with a usable answer become verified at the chosen value.

    ``lines`` has accession, key, value, metric_unit, confidence, source and notes; ``exhibits`` accession, file_name and html;
    ``answers`` accession, key, choice, answer_value, quote, answer_confidence, model and error. All lines are kept. A suspect line
    that stays withheld says why in its notes: no evidence in the exhibits, a failed request, or an answer that was declined or does
    not hold. One without a recorded answer stays as it is. Adds problem, null where there was none.
    """
    doubtful = adjudication_candidates(lines).select("accession", "key", "candidates")
    evidence = gather_evidence(exhibits, doubtful.withColumnRenamed("key", "metric"), ["accession"]).select("accession", c("metric").alias("key"), "evidence")
    asked = answers.select("accession", "key", F.struct("choice", "answer_value", "quote", "answer_confidence", "model", "error").alias("_a"))
    j = lines.join(doubtful, ["accession", "key"], "left").join(evidence, ["accession", "key"], "left").join(asked, ["accession", "key"], "left")
    a, open_ = c("_a"), c("candidates").isNotNull()
    wrong = answer_problem(c("candidates"), c("evidence"), a["choice"], a["answer_value"], a["quote"], a["answer_confidence"])
    problem = (F.when(open_ & c("evidence").isNull(), F.lit("no_evidence")).when(open_ & a["error"].isNotNull(), F.lit("failed"))
               .when(open_ & a.isNotNull(), wrong))
    j = j.withColumn("problem", problem)
    good = open_ & a.isNotNull() & c("problem").isNull()
    more = (F.when(good, F.array(F.concat(F.lit("adjudicated: "), a["quote"]), F.concat(F.lit("model: "), a["model"])))
            .when(c("problem") == "no_evidence", F.array(F.lit("adjudication skipped: no unit-explicit evidence")))
            .when(c("problem") == "failed", F.array(F.concat(F.lit("adjudication failed: "), a["error"])))
            .when(c("problem").isNotNull(), F.array(F.lit("adjudication declined; metric withheld"))).otherwise(F.array().cast("array<string>")))
    new = {"value": F.when(good, a["answer_value"]).otherwise(c("value")), "confidence": F.when(good, F.lit(fv.VERIFIED)).otherwise(c("confidence")),
           "source": F.when(good, F.lit(fv.FROM_ADJUDICATED)).otherwise(c("source")), "notes": F.concat(F.coalesce("notes", F.array().cast("array<string>")), more)}
    return j.select(*[new.get(x, c(x)).alias(x) for x in lines.columns], am.format_value(new["value"], c("metric_unit")).alias("value_text"), "problem")
