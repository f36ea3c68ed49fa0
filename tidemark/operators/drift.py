"""Document schemas over time: matching names, differences, merging, presence and convergence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tidemark import fixed_values as fv
from tidemark.functions import documents as docs, text as tx
from tidemark.operators.joins import asof_join, numbered, with_halo
from tidemark.session import written

c = F.col


def latest_version(schemas: DataFrame, keys: list[str] = ("type_id",)) -> DataFrame:
    """Rows of each type's highest version and the number the next one gets."""
    top = schemas.groupBy(*keys).agg(F.max("version").alias("version"))
    return schemas.join(top, [*keys, "version"]).withColumn("next_version", c("version") + 1)


def last_n(metrics: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows per key (limited before the shuffle)."""
    return metrics.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(c("_n") <= n).drop("_n")


def consecutive(schemas: DataFrame) -> DataFrame:
    """Each version's fields next to the same field in the version before (full outer, per type).

    Versions need not be numbered without gaps; the version before is the one that exists.
    """
    steps = (schemas.select("type_id", "version").distinct()
             .withColumn("prev", F.lag("version").over(W.partitionBy("type_id").orderBy("version"))))
    new = schemas.select("type_id", "version", "name", c("type").alias("new_type"), c("confidence").alias("new_confidence"))
    old = (schemas.withColumnRenamed("version", "prev").join(steps.where("prev IS NOT NULL"), ["type_id", "prev"])
           .select("type_id", "version", "name", c("type").alias("old_type"), c("confidence").alias("old_confidence")))
    return new.join(old, ["type_id", "version", "name"], "full_outer").join(
        steps.withColumn("first", c("prev").isNull()).drop("prev"), ["type_id", "version"])


def diff(schemas: DataFrame) -> DataFrame:
    """Fields added, removed, of another type or confidence than in the version before."""
    j = consecutive(schemas).where(~c("first"))
    both = c("new_type").isNotNull() & c("old_type").isNotNull()
    changes = F.array_compact(F.array(
        F.when(c("old_type").isNull(), F.lit("added")), F.when(c("new_type").isNull(), F.lit("removed")),
        F.when(both & (c("old_type") != c("new_type")), F.lit("modified")),
        F.when(both & (c("old_confidence") != c("new_confidence")), F.lit("confidence"))))
    return j.select("type_id", "version", "name", F.explode(changes).alias("change"), "old_type", "new_type",
                    "old_confidence", "new_confidence")


def version_metrics(schemas: DataFrame) -> DataFrame:
    """Field stability, confidence trend, new-field rate and type consistency of each version."""
    j = consecutive(schemas)
    has, had = c("new_type").isNotNull(), c("old_type").isNotNull()
    n = F.count_if(has)
    agg = j.groupBy("type_id", "version").agg(
        F.max("first").alias("_f"), n.alias("_n"), F.count_if(has & had).alias("_both"), F.count_if(has & ~had).alias("_add"),
        F.count_if(has & c("new_confidence").isin("high", "medium")).alias("_hi"),
        F.count_if(has & had & (c("new_type") == c("old_type"))).alias("_same"))
    ratio = lambda a, b: F.try_divide(c(a), c(b))
    some = ~c("_f") & (c("_n") > 0)
    return agg.select(
        "type_id", "version", F.when(some, ratio("_both", "_n")).otherwise(1.0).alias("field_stability"),
        F.coalesce(ratio("_hi", "_n"), F.lit(0.0)).alias("confidence_trend"),
        F.when(some, ratio("_add", "_n")).otherwise(0.0).alias("new_field_rate"),
        F.when(~c("_f") & (c("_both") > 0), ratio("_same", "_both")).otherwise(1.0).alias("type_consistency"))


def metric_rows(metrics: DataFrame) -> DataFrame:
    return metrics.unpivot(["type_id", "version"], fv.CONVERGENCE_METRICS, "metric", "value")


def convergence(metrics: DataFrame, n: int = 5) -> DataFrame:
    """Score per type from the mean of the last values of each metric; fewer than two values count as zero."""
    recent = last_n(metrics, ["type_id", "metric"], [F.desc("version")], n)
    mean = recent.groupBy("type_id", "metric").agg(F.when(F.count("*") >= 2, F.avg("value")).otherwise(0.0).alias("m"))
    one = lambda k: F.coalesce(F.max(F.when(c("metric") == k, c("m"))), F.lit(0.0))
    stab, conf, new, cons = [one(k) for k in fv.CONVERGENCE_METRICS]
    return mean.groupBy("type_id").agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), (stab + conf + (1.0 - new) + cons) / 4.0)).alias("score"))


def indicators(schemas: DataFrame, analyses: DataFrame) -> DataFrame:
    """Share of high and medium confidence in the latest schema, and files analysed."""
    share = latest_version(schemas).groupBy("type_id").agg(
        F.avg(c("confidence").isin("high", "medium").cast("double")).alias("average_confidence"), F.count("*").alias("fields"))
    files = analyses.groupBy("type_id").agg(F.count("*").alias("files_analyzed"))
    return share.join(files, "type_id", "left").withColumn("files_analyzed", F.coalesce("files_analyzed", F.lit(0)))


def assigned_names(found: DataFrame, canonical: DataFrame) -> DataFrame:
    """Which found name of a document stands for which canonical field: type_id, version, doc_no, name, found_name.

    ``found`` has the names of each document (type_id, version, doc_no, found_name), ``canonical`` the fields in force for a version
    (type_id, version, name, position). Fields in order take their best free name, each name once. Documents with the same names and
    version are assigned together.
    """
    sets = found.groupBy("type_id", "version", "doc_no").agg(F.array_sort(F.collect_set("found_name")).alias("names"))
    sets = written(sets, "name_sets")
    pairs = written(name_pairs(canonical, found, "name", "found_name"), "name_pairs")
    each = sets.select("type_id", "version", "names").distinct().withColumn("found_name", F.explode("names"))
    edges = each.join(pairs, ["type_id", "found_name"]).join(canonical.select("type_id", "version", "name", "position"), ["type_id", "version", "name"])
    picks = match_once(edges, ["type_id", "version", "names"], "name", "found_name", "position").select("type_id", "version", "names", "name", "found_name")
    return sets.join(picks, ["type_id", "version", "names"]).select("type_id", "version", "doc_no", "name", "found_name")


def presence(found: DataFrame, canonical: DataFrame) -> DataFrame:
    """Per type and canonical field: documents that carried it, its share, last sample and other spellings in order of appearance.

    ``found`` has one row per document and name in it (type_id, version, doc_no, found_name, sample), ``canonical`` the fields in force
    for each version (type_id, version, name, position). A field that has left the schema keeps its count, over all documents. Blank
    samples do not replace one. Spellings that differ in case only are one, written as first seen; the field's own is none.
    """
    analysed = found.select("type_id", "doc_no").distinct().groupBy("type_id").agg(F.count("*").alias("documents"))
    hits = assigned_names(found, canonical).join(found.select("type_id", "version", "doc_no", "found_name", F.trim("sample").alias("sample")),
                                                 ["type_id", "version", "doc_no", "found_name"])
    per = hits.groupBy("type_id", "name", F.lower("found_name").alias("_low")).agg(
        F.min(F.struct("doc_no", "found_name")).alias("_first"), F.count("*").alias("_k"), F.max(F.when(c("sample") != "", F.struct("doc_no", "sample"))).alias("_last"))
    stats = per.groupBy("type_id", "name").agg(
        F.sum("_k").alias("document_count"), F.max("_last").alias("_last"),
        F.transform(F.array_sort(F.collect_list(F.when(c("_low") != F.lower("name"), c("_first")))), lambda x: x["found_name"]).alias("aliases"))
    return (canonical.select("type_id", "name").distinct().join(stats, ["type_id", "name"], "left").join(analysed, "type_id", "left")
            .select("type_id", "name", F.coalesce("document_count", F.lit(0)).alias("document_count"),
                    F.coalesce(F.try_divide(F.coalesce("document_count", F.lit(0)), "documents"), F.lit(0.0)).alias("presence_rate"),
                    c("_last.sample").alias("sample"), F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases")))


def absence_streaks(schemas: DataFrame, versions: DataFrame) -> DataFrame:
    """For each field once seen: versions since it was last there, deprecation and the confidence left.

    Confidence falls one level per version without the field; more than three such versions deprecate it.
    """
    numbered = versions.select("type_id", "version").distinct().withColumn(
        "_i", F.row_number().over(W.partitionBy("type_id").orderBy("version")))
    last = schemas.join(numbered, ["type_id", "version"]).groupBy("type_id", "name").agg(
        F.max(F.struct("_i", "confidence")).alias("_l"))
    top = numbered.groupBy("type_id").agg(F.max("_i").alias("_top"))
    streak = c("_top") - c("_l._i")
    level = F.when(streak == 0, c("_l.confidence")).when((streak == 1) & (c("_l.confidence") == "high"), F.lit("medium")).otherwise(F.lit("low"))
    return last.join(top, "type_id").select("type_id", "name", streak.cast("bigint").alias("absence_streak"),
                                            (streak > 3).alias("deprecated"), level.alias("confidence"))


def unique_names(fields: DataFrame, keys: list[str], name: str, order: list[str]) -> DataFrame:
    """Repeated names get ``_2``, ``_3`` … in order.

    A suffixed name that collides with a literal one moves on to the next free number, as a walk in order
    would do. The walk runs per schema (tens of fields).
    """
    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        used: set[str] = set()
        out = []
        for n in pdf[name]:
            pick, i = n, 2
            while pick in used:
                pick, i = f"{n}_{i}", i + 1
            used.add(pick)
            out.append(pick)
        return pdf.assign(unique_name=out)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema) + ", unique_name string"
    return fields.groupBy(*keys).applyInPandas(walk, schema)


def match_tier(a: Column, b: Column) -> Column:
    """How two field names match: 1 equal but for case, 2 equal in normal form, 3 similar."""
    return (F.when(F.lower(a) == F.lower(b), 1).when(tx.name_form(a) == tx.name_form(b), 2)
            .when(tx.names_similar(a, b), 3))


def _match_keys(name: Column, whole: str, part: str, trim: bool = True) -> Column:
    """Keys of which two names that match in some tier share one: lower case, normal form, its first four characters,
    and for one name inside the other the ``whole`` name there and the ``part`` (every substring) here."""
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    form, low = tx.name_form(name), F.lower(F.trim(name) if trim else name)
    n = F.length(low)
    parts = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(
        F.sequence(F.lit(1), n - i + 1), lambda k: key(part, F.substring(low, i, k)))))
    base = F.array(key("lower", F.lower(name)), key("form", form), key("stem", F.substring(form, 1, 4)), key(whole, low))
    return F.array_distinct(F.concat(base, F.when(n > 0, parts).otherwise(F.array().cast("array<struct<kind:string,key:string>>"))))


def name_pairs(left: DataFrame, right: DataFrame, a: str, b: str) -> DataFrame:
    """Pairs of distinct names of one type that match in some tier.

    Candidates share a key, so names of a type that have nothing in common are never paired.
    """
    l = left.select("type_id", a).distinct().withColumn("_k", F.explode(_match_keys(c(a), "left whole", "right whole")))
    r = right.select("type_id", b).distinct().withColumn("_k", F.explode(_match_keys(c(b), "right whole", "left whole")))
    pairs = l.join(r, ["type_id", "_k"]).select("type_id", a, b).distinct()
    return pairs.withColumn("tier", match_tier(c(a), c(b))).where("tier IS NOT NULL")


def match_once(pairs: DataFrame, keys: list[str], canonical: str, found: str, position: str) -> DataFrame:
    """Assign found names to canonical fields: fields in order take their best free match, each name once.

    A fold over one key's pairs by position, tier and name: a pair is taken if neither its field nor its name is taken yet. The state
    is the pairs taken so far, at most one per field.
    """
    rest = [x for x in pairs.columns if x not in (*keys, position, "tier", found)]
    edges = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(position, "tier", found, *rest))).alias("_e"))
    taken = lambda acc, e: F.exists(acc, lambda p: (p[position] == e[position]) | (p[found] == e[found]))
    picks = F.aggregate("_e", F.array().cast(edges.schema["_e"].dataType), lambda acc, e: F.when(taken(acc, e), acc).otherwise(F.concat(acc, F.array(e))))
    return edges.select(*keys, F.inline(picks)).select(*pairs.columns)


def resolve_hints(hints: DataFrame, fields: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """Field each user hint means: equal but for case, equal in normal form, or one inside the other; first field wins.

    With ``versions`` (type_id, version) the fields have versions and each hint is looked up in each of them.
    """
    by = ["type_id"] if versions is None else ["type_id", "version"]
    asked = hints if versions is None else hints.join(versions, "type_id")
    h, f = F.lower("label"), F.lower("name")
    tier = (F.when(h == f, 1).when(tx.name_form(c("label")) == tx.name_form(c("name")), 2)
            .when(F.contains(f, h) | F.contains(h, f), 3))
    one = hints.select("type_id", "label").distinct().withColumn("_k", F.explode(_match_keys(c("label"), "label whole", "name whole", trim=False)))
    two = fields.select("type_id", "name").distinct().withColumn("_k", F.explode(_match_keys(c("name"), "name whole", "label whole", trim=False)))
    near = one.join(two, ["type_id", "_k"]).select("type_id", "label", "name").distinct().withColumn("tier", tier).where("tier IS NOT NULL")
    pairs = (near.join(fields.select(*by, "name", "position", "type", "confidence"), ["type_id", "name"]).groupBy(*by, "label")
             .agg(F.min_by(F.struct("name", "type", "confidence"), F.struct("tier", "position")).alias("_m")))
    return (asked.join(pairs, [*by, "label"], "left")
            .select(*asked.columns, c("_m.name").alias("mapped_to"), c("_m.type").alias("mapped_type"), c("_m.confidence").alias("confidence"),
                    c("_m").isNotNull().alias("found")))


def without_excluded(fields: DataFrame, excluded: DataFrame) -> DataFrame:
    """Fields whose name is not similar to an excluded name of the type."""
    bad = name_pairs(fields, excluded, "name", "excluded").select("type_id", "name").distinct()
    return fields.join(bad, ["type_id", "name"], "left_anti")


def add_excluded(excluded: DataFrame, new: DataFrame) -> DataFrame:
    """Append names to the exclusion list unless a similar one is there."""
    n = new.select("type_id", F.trim("excluded").alias("candidate")).where("candidate <> ''").distinct()
    known = name_pairs(n, excluded, "candidate", "excluded").select("type_id", "candidate").distinct()
    fresh = n.join(known, ["type_id", "candidate"], "left_anti").select("type_id", c("candidate").alias("excluded"))
    return excluded.select("type_id", "excluded").unionByName(fresh)


def proposed_fields(proposed: DataFrame, hints: DataFrame, excluded: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """The fields that a proposal brings into a schema: hinted ones under the user's label, then the model's that no hint means.

    Inputs: proposed(type_id[, version], name, type, confidence, position), hints(type_id, label, hint_type, required[, hint_no]),
    excluded(type_id, excluded). A hint that means no field is a field of its own with low confidence. With ``versions`` each
    version is a proposal of its own.
    """
    by = ["type_id"] if versions is None else ["type_id", "version"]
    proposal = written(without_excluded(proposed, excluded), "proposal")
    hinted = written(resolve_hints(hints, proposal, versions), "hinted")
    hint_no = c("hint_no").cast("bigint") if "hint_no" in hints.columns else F.lit(0).cast("bigint")
    user = hinted.select(
        *by, c("label").alias("name"), F.coalesce("mapped_type", F.when(c("hint_type") != "", c("hint_type")), F.lit("string")).alias("type"),
        F.coalesce("confidence", F.lit("low")).alias("confidence"), F.lit("user").alias("provenance"), (c("found") | c("required")).alias("required"), hint_no.alias("hint_no"))
    taken = hinted.select(*by, F.explode(F.array("label", "mapped_to")).alias("name")).where("name IS NOT NULL").distinct()
    model = proposal.join(taken, [*by, "name"], "left_anti").select(
        *by, "name", "type", "confidence", F.lit("llm").alias("provenance"), F.lit(False).alias("required"), F.lit(0).cast("bigint").alias("hint_no"))
    return user.unionByName(model)


def _place() -> Column:
    """The part of a schema a field is in: user fields 0, model fields 1, deprecated ones 2."""
    return F.when(c("deprecated"), 2).when(c("provenance") == "user", 0).otherwise(1)


def merge_schema(current: DataFrame, proposed: DataFrame, hints: DataFrame, excluded: DataFrame) -> DataFrame:
    """Next version of each type's schema: hinted fields, then proposed ones, then those carried or deprecated.

    Inputs as in ``proposed_fields``, and current(type_id, name, type, confidence, provenance, absence_streak, required). A carried
    field keeps its required flag. place orders the parts of the result.
    """
    current, excluded = written(current, "current"), written(excluded, "excluded")
    new = written(proposed_fields(proposed, hints, excluded), "new_fields")
    old = c("_o")
    both = new.select("type_id", "name", F.struct("type", "confidence", "provenance", "required").alias("_n")).join(
        current.select("type_id", "name", F.struct("type", "confidence", "provenance", "required", "absence_streak").alias("_o")), ["type_id", "name"], "full_outer")
    fresh, gone = c("_n").isNotNull(), F.when(c("_n").isNull(), old["absence_streak"] + 1)
    note = F.when((c("_n.provenance") == "llm") & (old["type"] != c("_n.type")), F.concat(F.lit("type conflict: "), old["type"], F.lit(" to "), c("_n.type"))).otherwise(F.lit(""))
    either = lambda x: F.when(fresh, c(f"_n.{x}")).otherwise(old[x])
    merged = both.select(
        "type_id", "name", either("type").alias("type"), F.when(fresh, c("_n.confidence")).otherwise(tx.downgrade(old["confidence"])).alias("confidence"),
        either("provenance").alias("provenance"), either("required").alias("required"), F.coalesce(gone, F.lit(0)).alias("absence_streak"),
        F.coalesce(gone > 3, F.lit(False)).alias("deprecated"), note.alias("note"), fresh.alias("_fresh"))
    carried = without_excluded(merged.where(~c("_fresh")), excluded)
    return merged.where("_fresh").unionByName(carried).drop("_fresh").withColumn("place", _place())


def _faded(confidence: Column, steps: Column) -> Column:
    """A confidence after so many versions without the field."""
    return F.when(steps <= 0, confidence).when((steps == 1) & (confidence == "high"), F.lit("medium")).otherwise(F.lit("low"))


def refined_versions(proposed: DataFrame, hints: DataFrame, excluded: DataFrame) -> DataFrame:
    """The schema of every version of every type, each made from the one before and the version's own proposal.

    One row per type, version and field known by then: type, confidence, provenance, required, absence_streak, deprecated, place and
    position (the order of the fields), and the field's state in the version before (old_type null: not known; old_confidence,
    old_deprecated). i counts the versions of a type from 1.

    What a step leaves of a field depends only on the last proposal that had it and on the versions since, so no step waits for the one
    before: each appearance gives the rows up to the next one. A type with very many versions is many tasks.
    """
    stretch = lambda x: F.floor(x / 1000)
    versions = written(numbered(proposed.select("type_id", "version").distinct(), ["type_id"], "version", stretch, "i"), "versions")
    excluded = written(excluded, "excluded")
    state = ["type", "confidence", "provenance", "required", "hint_no"]
    here = proposed_fields(written(proposed, "proposed"), hints, excluded, versions.select("type_id", "version")).join(versions, ["type_id", "version"])
    here = written(here.select("type_id", "i", "name", *state), "appearances")
    top = versions.groupBy("type_id").agg(F.max("i").alias("top"))
    seen = here.select("type_id", "name", c("i").alias("at"), c("type").alias("was_type"), c("confidence").alias("was_confidence"))
    key = ["type_id", "name"]
    before = asof_join(here, seen, key, "i", "at", ["was_type", "was_confidence"], bucket=stretch).withColumnRenamed("at", "was")
    spans = asof_join(before, seen, key, "i", "at", [], forward=True, tie_break=["at"], bucket=stretch).join(top, "type_id")
    k, since = c("i") - c("from"), c("from") - 1 - c("was")
    rows = spans.withColumnRenamed("i", "from").withColumn("i", F.explode(F.sequence(c("from"), F.coalesce(c("at") - 1, c("top")))))
    rows = rows.select(
        "type_id", "i", "name", "type", _faded(c("confidence"), k).alias("confidence"), "provenance", "required", k.alias("absence_streak"), (k > 3).alias("deprecated"),
        F.when(k > 0, c("type")).otherwise(c("was_type")).alias("old_type"),
        F.when(k > 0, _faded(c("confidence"), k - 1)).otherwise(_faded(c("was_confidence"), since)).alias("old_confidence"),
        F.when(k > 0, k - 1 > 3).otherwise(since > 3).alias("old_deprecated"), "hint_no")
    rows = rows.withColumn("place", _place())
    position = F.struct(c("place"), (c("absence_streak") > 0).alias("carried"), c("hint_no"), c("name").alias("field"))
    return rows.withColumn("position", position).drop("hint_no").join(versions, ["type_id", "i"])


def refinement(rows: DataFrame) -> DataFrame:
    """One row per type and version of ``refined_versions``: differences to the version before, metrics and convergence.

    Columns: version, next_version, fields (not deprecated), deprecated, added, removed (known fields that are not in force, in each
    version), modified, confidence_changes, type_conflicts (of the model's fields), the four metrics, score and advice.
    """
    live, known = ~c("deprecated"), c("old_type").isNotNull()
    n = lambda x: F.count_if(F.coalesce(x, F.lit(False)))
    retyped = known & (c("type") != c("old_type"))
    per = rows.groupBy("type_id", "i", "version").agg(
        n(live).alias("fields"), n(~live).alias("deprecated"), n(live & ~known).alias("added"), n(known & ~live).alias("removed"), n(live & retyped).alias("modified"),
        n(live & known & (c("confidence") != c("old_confidence"))).alias("confidence_changes"),
        n(retyped & (c("provenance") == "llm") & (c("absence_streak") == 0)).alias("type_conflicts"),
        n(live & known & ~c("old_deprecated")).alias("_both"), n(live & c("confidence").isin("high", "medium")).alias("_hi"), n(live & known).alias("_known"))
    some = (c("i") > 1) & (c("fields") > 0)
    per = per.withColumns({
        "field_stability": F.when(some, c("_both") / c("fields")).otherwise(1.0), "confidence_trend": F.coalesce(F.try_divide(c("_hi"), c("fields")), F.lit(0.0)),
        "new_field_rate": F.when(some, (c("fields") - c("_both")) / c("fields")).otherwise(0.0),
        "type_consistency": F.when((c("i") > 1) & (c("_known") > 0), (c("_known") - c("modified")) / c("_known")).otherwise(1.0)})
    last = W.partitionBy("type_id", "_s").orderBy("i").rowsBetween(-4, 0)
    recent = [F.when(F.count("*").over(last) >= 2, F.avg(m).over(last)).otherwise(0.0) for m in fv.CONVERGENCE_METRICS]
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (recent[0] + recent[1] + (1.0 - recent[2]) + recent[3]) / 4.0))
    scored = with_halo(per, 4, 1000, "i").withColumn("score", score).where("_own")
    return scored.select("type_id", "version", (c("version") + 1).alias("next_version"), "fields", "deprecated", "added", "removed", "modified", "confidence_changes",
                         "type_conflicts", *fv.CONVERGENCE_METRICS, "score", docs.recommendation(F.round("score", 9)).alias("advice"))


def proposal_errors(fields: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Problems of proposed fields, one row per field and error code."""
    dup = W.partitionBy(*keys, "name").orderBy(*order)
    codes = F.array_compact(F.array(
        F.when(c("name") == "", F.lit("empty_name")),
        F.when((c("name") != "") & F.contains("name", F.lit(" ")), F.lit("invalid_name")),
        F.when(~F.coalesce(c("type"), F.lit("")).isin(fv.FIELD_TYPES), F.lit("invalid_type")),
        F.when(~F.coalesce(c("confidence"), F.lit("")).isin(fv.CONFIDENCE_LEVELS), F.lit("invalid_confidence")),
        F.when(c("_dup") > 1, F.lit("duplicate_name"))))
    return fields.withColumn("_dup", F.row_number().over(dup)).withColumn("code", F.explode(codes)).drop("_dup")


def proposal_questions(proposals: DataFrame) -> DataFrame:
    """Problems of a proposal as a whole: no fields, no strategy, missing questions, and one per unnamed question."""
    codes = F.array_compact(F.array(
        F.when(c("n_fields").isNull(), F.lit("nil_fields")),
        F.when(~c("use_ocr") & ~c("convert_to_image") & ~c("multi_pass") & (F.coalesce("rationale", F.lit("")) == ""), F.lit("empty_strategy")),
        F.when(c("needs_help") & (F.size("question_ids") == 0), F.lit("missing_questions"))))
    unnamed = F.transform(F.filter("question_ids", lambda q: q == ""), lambda q: F.lit("empty_question_id"))
    return proposals.withColumn("code", F.explode(F.concat(codes, F.coalesce(unnamed, F.array().cast("array<string>")))))


def strategy_consensus(analyses: DataFrame, n: int = 5) -> DataFrame:
    """Commonest strategy of the latest analyses per type; on a tie the one that reached its count first (newest first)."""
    order = [F.desc("created_at"), F.desc("doc_no")]
    newest = last_n(analyses, ["type_id"], order, n)
    pos = F.row_number().over(W.partitionBy("type_id").orderBy(*order))
    per = newest.withColumn("_i", pos).groupBy("type_id", "strategy").agg(F.count("*").alias("n"), F.max("_i").alias("at"))
    # Every strategy reaches its own final count at its last position.
    return per.groupBy("type_id").agg(F.max_by("strategy", F.struct(c("n"), -c("at"))).alias("strategy"))


def build_views(types: DataFrame, schemas: DataFrame, config: DataFrame, samples: DataFrame) -> DataFrame:
    """One row per type that has a schema: latest version, number of samples, build status when configured."""
    top = schemas.groupBy("type_id").agg(F.max("version").alias("version"))
    fields = schemas.join(top, ["type_id", "version"]).groupBy("type_id", "version").agg(F.count("*").alias("fields"))
    n = samples.groupBy("type_id").agg(F.count("*").alias("sample_count"))
    return (types.join(fields, "type_id").join(config, "type_id", "left").join(n, "type_id", "left")
            .withColumn("sample_count", F.coalesce("sample_count", F.lit(0))))


def field_rows(fields: DataFrame, overrides: DataFrame, stats: DataFrame) -> DataFrame:
    """Schema fields with the user's override (else the default one) and how many documents carried them."""
    o = overrides.select("type_id", "name", F.struct("included", "required", "emphasis").alias("_o"))
    default = F.struct(F.lit(True).alias("included"), c("required"), F.lit("normal").alias("emphasis"))
    return (fields.join(o, ["type_id", "name"], "left").join(stats, ["type_id", "name"], "left")
            .withColumn("_o", F.coalesce("_o", default))
            .select("type_id", "name", "type", c("_o.included").alias("included"), c("_o.required").alias("override_required"),
                    c("_o.emphasis").alias("emphasis"), F.coalesce("document_count", F.lit(0)).alias("seen_in")))


def by_emphasis(rows: DataFrame) -> DataFrame:
    weight = F.when(c("emphasis") == "critical", 2).when(c("emphasis") == "high", 1).otherwise(0)
    return rows.where("included").orderBy("type_id", weight.desc(), "name")


def duplicate_samples(incoming: DataFrame, samples: DataFrame) -> DataFrame:
    """Stored sample each incoming document repeats: same hash, else same size and name but for case."""
    by_hash = samples.where("content_hash <> ''").groupBy("type_id", "content_hash").agg(F.min("sample_id").alias("_exact"))
    by_name = samples.groupBy("type_id", "size_bytes", F.lower("original_name").alias("_n")).agg(F.min("sample_id").alias("_named"))
    j = (incoming.withColumn("_n", F.lower(F.trim("original_name")))
         .join(by_hash, ["type_id", "content_hash"], "left").join(by_name, ["type_id", "size_bytes", "_n"], "left"))
    return (j.withColumn("match_type", F.when(c("_exact").isNotNull(), F.lit("exact")).when(c("_named").isNotNull(), F.lit("name_size")))
            .withColumn("sample_id", F.coalesce("_exact", "_named")).drop("_exact", "_named", "_n"))


def register_samples(samples: DataFrame, incoming: DataFrame) -> DataFrame:
    """Sample registry after a batch: repeats raise the count and last-seen time and bring their file, new documents are added.

    A stored blank hash is filled from the first repeat that has one. New documents that repeat each other become one sample: by
    the hash of a new sample, else, hash or not, by size and name without case. A new sample has the first hash of its size and
    name; of new samples with one hash the first counts.
    """
    matched = duplicate_samples(incoming, samples)
    hits = matched.where("sample_id IS NOT NULL").groupBy("type_id", "sample_id").agg(
        F.count("*").alias("_k"), F.max("seen_at").alias("_seen"), F.max_by("doc_id", F.struct("seen_at", "doc_id")).alias("_file"),
        F.min_by("content_hash", F.when(c("content_hash") != "", F.struct("seen_at", "doc_id"))).alias("_hash"))
    old = samples.join(hits, ["type_id", "sample_id"], "left").select(
        "type_id", "sample_id", F.coalesce("_file", "file_id").alias("file_id"), "original_name", "size_bytes",
        F.when((c("content_hash") == "") & c("_hash").isNotNull(), c("_hash")).otherwise(c("content_hash")).alias("content_hash"),
        "first_seen_at", F.greatest("last_seen_at", "_seen").alias("last_seen_at"),
        (c("analysis_count") + F.coalesce("_k", F.lit(0))).alias("analysis_count"))
    at = F.struct("seen_at", "doc_id")
    fresh = matched.where("sample_id IS NULL").withColumn("_n", F.lower(F.trim("original_name")))
    named = fresh.groupBy("type_id", "size_bytes", "_n").agg(
        F.min(at).alias("_at"), F.min_by("content_hash", F.when(c("content_hash") != "", at)).alias("_h"))
    hashed = named.where("_h IS NOT NULL").groupBy("type_id", c("_h").alias("content_hash")).agg(F.min("_at").alias("_first"))
    group = (named.join(hashed.withColumnRenamed("content_hash", "_h"), ["type_id", "_h"], "left")
             .select("type_id", "size_bytes", "_n", c("_h").alias("_hash"), F.coalesce("_first", "_at").alias("_by_name")))
    new = (fresh.join(group, ["type_id", "size_bytes", "_n"]).join(hashed, ["type_id", "content_hash"], "left")
           .withColumn("_id", F.coalesce("_first", "_by_name"))
           .groupBy("type_id", "_id").agg(
        F.min_by(F.struct("doc_id", "original_name", "size_bytes", "_hash"), at).alias("f"), F.max_by("doc_id", at).alias("file_id"),
        F.min("seen_at").alias("first_seen_at"), F.max("seen_at").alias("last_seen_at"), F.count("*").alias("analysis_count"))
        .select("type_id", c("f.doc_id").alias("sample_id"), "file_id", F.trim("f.original_name").alias("original_name"), c("f.size_bytes").alias("size_bytes"),
                F.coalesce("f._hash", F.lit("")).alias("content_hash"), "first_seen_at", "last_seen_at", "analysis_count"))
    return old.unionByName(new)


def schema_hash(fields: DataFrame, keys: list[str]) -> DataFrame:
    """Hash of each schema's fields in name order, as JSON."""
    packed = F.to_json(F.array_sort(F.collect_list(F.struct("name", "type", "confidence"))))
    return fields.groupBy(*keys).agg(F.sha2(packed, 256).alias("schema_hash"))

