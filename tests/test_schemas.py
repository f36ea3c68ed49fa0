"""Names of documents assigned to schema fields, presence over versions, and schemas refined version by version, against walks."""

import random

from pyspark.sql import functions as F

from tidemark.operators import drift as dr

FOUND = "type_id int, version int, doc_no int, found_name string, sample string"
CANON = "type_id int, version int, name string, position int"


def form(x):
    return "".join(c for c in x.strip().lower() if c not in " _-")


def similar(a, b):
    a, b = a.strip().lower(), b.strip().lower()
    if not a or not b:
        return False
    na, nb = form(a), form(b)
    if a == b or na == nb or a in b or b in a:
        return True
    short = min(len(na), len(nb))
    same = next((i for i in range(short) if na[i] != nb[i]), short)
    return short >= 4 and same >= min(max(short - 2, 6), short)


def tier(a, b):
    return 1 if a.lower() == b.lower() else 2 if form(a) == form(b) else 3 if similar(a, b) else None


def walk(fields, names):
    """Field -> name: fields in order take their best free name."""
    used, out = set(), {}
    for f in fields:
        best = min(((tier(f, n), n) for n in names if n not in used and tier(f, n)), default=None)
        if best:
            used.add(best[1])
            out[f] = best[1]
    return out


def slow_presence(found, canon):
    docs = {}
    for t, v, d, n, s in found:
        docs.setdefault((t, d), (v, {}))[1][n] = s
    stats = {(t, n): [0, None, []] for t, _, n, _ in canon}
    for (t, d), (v, names) in sorted(docs.items()):
        fields = [n for p, n in sorted((p, n) for tt, vv, n, p in canon if (tt, vv) == (t, v))]
        for f, n in walk(fields, names).items():
            one = stats[t, f]
            one[0] += 1
            if names[n] and names[n].strip(" "):
                one[1] = names[n].strip(" ")
            if n.lower() != f.lower() and n.lower() not in [x.lower() for x in one[2]]:
                one[2].append(n)
    total = {t: sum(1 for tt, _ in docs if tt == t) for t, _ in docs}
    return {k: (n, n / total[k[0]] if k[0] in total else 0.0, s, al) for k, (n, s, al) in stats.items()}


def fast_presence(spark, found, canon):
    rows = dr.presence(spark.createDataFrame(found, FOUND), spark.createDataFrame(canon, CANON)).collect()
    return {(r.type_id, r.name): (r.document_count, r.presence_rate, r.sample, r.aliases) for r in rows}


def test_spellings_and_fields_that_left(spark):
    canon = [(1, 1, "vendor", 1), (1, 1, "vendor_name", 2), (1, 1, "old", 3), (1, 2, "vendor", 1), (1, 2, "vendor_name", 2), (2, 1, "never", 1)]
    found = [(1, 1, 1, "Vendor Name", " x "), (1, 1, 1, "VENDOR", ""), (1, 1, 1, "Old", "gone"), (1, 2, 2, "VENDOR NAME", "y"), (1, 2, 2, "old", "left"),
             (1, 2, 3, "Vendor-Name", " "), (1, 2, 3, "vendor", "z")]
    got = fast_presence(spark, found, canon)
    assert got == slow_presence(found, canon)
    assert got[1, "vendor"] == (3, 1.0, "z", ["VENDOR NAME"])  # a field takes a similar name if no better one is there
    assert got[1, "vendor_name"] == (2, 2 / 3, "x", ["Vendor Name", "Vendor-Name"])  # as given, not in lower case
    assert got[1, "old"] == (1, 1 / 3, "gone", []) and got[2, "never"] == (0, 0.0, None, [])


def test_assignment_equals_the_walk(spark):
    rnd = random.Random(7)
    words = ["invoice_number", "Invoice Number", "invoice_no", "INVOICE_NUMBER", "total", "Total Amount", "total_amount", "amount", "", " ", "po", "PO-", "vendor_name", "vendorname"]
    canon = [(t, v, n, i) for t in (1, 2) for v in (1, 2) for i, n in enumerate(rnd.sample([w for w in words if w.strip()], 7))]
    found = [(t, rnd.choice([1, 2]), d, None, None) for t in (1, 2) for d in range(40)]
    found = [(t, v, d, n, rnd.choice([None, "", " s", str(d)])) for t, v, d, _, _ in found for n in rnd.sample(words, rnd.randrange(1, 8))]
    assert fast_presence(spark, found, canon) == slow_presence(found, canon)


def slow_refine(proposals, hints, excluded):
    """Per version: fields with their state, and the differences to the version before."""
    down = {"high": "medium"}
    state, out = {}, []
    for version, fields in proposals:
        fields = [f for f in fields if not any(similar(f[0], x) for x in excluded)]
        new, taken = {}, set()
        for label, kind, required in hints:
            hit = min(((1 if f[0].lower() == label.lower() else 2 if form(f[0]) == form(label) else 3, i) for i, f in enumerate(fields)
                       if f[0].lower() == label.lower() or form(f[0]) == form(label) or f[0].lower() in label.lower() or label.lower() in f[0].lower()), default=None)
            taken.add(label)
            if hit:
                f = fields[hit[1]]
                taken.add(f[0])
                new[label] = [f[1], f[2], "user", True, 0]
            else:
                new[label] = [kind or "string", "low", "user", required, 0]
        for name, kind, confidence in fields:
            if name not in taken:
                new[name] = [kind, confidence, "llm", False, 0]
        for name, (kind, confidence, who, required, streak) in state.items():
            if name not in new:
                new[name] = [kind, down.get(confidence, "low"), who, required, streak + 1]
        live = {n for n, f in new.items() if f[4] <= 3}
        both = [n for n in live if n in state]
        out.append((version, {n: tuple(f) for n, f in new.items()}, None if not state else (
            len(live - set(state)), len(set(state) - live), sum(new[n][0] != state[n][0] for n in both), sum(new[n][1] != state[n][1] for n in both))))
        state = new
    return out


def test_refinement_equals_step_by_step(spark):
    rnd = random.Random(8)
    names = ["amount", "total_amount", "vendor", "due date", "paid", "iban", "notes", "Vendor Code", "lines"]
    proposals = {t: [(v * 3, [(n, rnd.choice(["string", "number"]), rnd.choice(["high", "medium", "low"])) for n in sorted(rnd.sample(names, rnd.randrange(1, 6)))])
                     for v in range(30)] for t in (1, 2)}
    hints = {1: [("Amount", "", False), ("shipping", "date", True)], 2: []}
    excluded = {1: ["note"], 2: ["Lines", "vendor code"]}
    rows = spark.createDataFrame([(t, v, *f, i) for t, vs in proposals.items() for v, fs in vs for i, f in enumerate(fs)],
                                 "type_id int, version int, name string, type string, confidence string, position int")
    hint_rows = spark.createDataFrame([(t, *h, i) for t, hs in hints.items() for i, h in enumerate(hs)], "type_id int, label string, hint_type string, required boolean, hint_no int")
    done = dr.refined_versions(rows, hint_rows, spark.createDataFrame([(t, x) for t, xs in excluded.items() for x in xs], "type_id int, excluded string"))
    got = {}
    for r in done.collect():
        got.setdefault((r.type_id, r.version), {})[r.name] = (r.type, r.confidence, r.provenance, r.required, r.absence_streak)
    steps = {(r.type_id, r.version): r for r in dr.refinement(done).collect()}
    for t in (1, 2):
        for version, state, diff in slow_refine(proposals[t], hints[t], excluded[t]):
            assert got[t, version] == state
            s = steps[t, version]
            assert s.deprecated == sum(f[4] > 3 for f in state.values()) and s.next_version == version + 1
            if diff:
                assert (s.added, s.removed, s.modified, s.confidence_changes) == diff
    assert any(s.removed and s.added for s in steps.values())


def test_refinement_has_few_shuffles(spark):
    rows = spark.createDataFrame([(1, 1, "a", "string", "high", 1)], "type_id int, version int, name string, type string, confidence string, position int")
    hints = spark.createDataFrame([], "type_id int, label string, hint_type string, required boolean")
    none = spark.createDataFrame([], "type_id int, excluded string")
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    assert exchanges(dr.refinement(dr.refined_versions(rows, hints, none))) < 30
    current = rows.select("type_id", "name", "type", "confidence", F.lit("llm").alias("provenance"), F.lit(0).alias("absence_streak"), F.lit(False).alias("required"))
    assert exchanges(dr.merge_schema(current, rows.drop("version"), hints, none)) < 30
