"""Operator 11 against brute force for the base spans, planted spans for the learnt ones, and its edge cases."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from veritab.llm import personal_data as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def card(rng, n=16):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def base_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p or 0) <= 255 for p in m[0].split(".")),
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def check_base(docs):
    rows = {r["at"]: r["text"] for r in docs.collect()}
    got = P.digest(P.personal_data(docs.drop("doc_id"), id_col="at")).collect()
    assert len(got) == len(rows)
    for r in got:
        expected = base_spans(rows[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(expected).encode()).hexdigest(), rows[r["doc_id"]][:200]
        assert [r[f"n_{k}"] for k in PLAIN] == [sum(s.startswith(k) for s in expected) for k in PLAIN]
        found = r["spans"].split(",") if r["spans"] else []
        assert set(expected) <= set(found) and len(found) == len(expected) + r["n_added"]
        order = [(int(a), list(PLAIN).index(k)) for k, a, _ in (s.split(":") for s in found)]
        assert order == sorted(order)


def numbered(df):
    return df.select("*", F.monotonically_increasing_id().alias("at"))


def test_base_spans_equal_brute_force(spark):
    rng = random.Random(7)
    bits = ["a", "b.c", "@", ".", "..", "x@y.z", "_", "-", " ", "1", "22", "333", "256", "0", "+", "(", ")", "é", "😀", ":", "a@b-c.d",
            "1.2.3.4", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1111", "\n", "\t", "00255.1.1.1"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(3000)]
    check_base(numbered(spark.createDataFrame([(0, t) for t in texts], "doc_id long, text string")))


def long_runs(n):
    return ["a@b" + ".c" * n, "a" * n, "1 " * n, "1" * n, "+1" + " " * n, "+1(" * n, "1." * n, "u@v.w " * n, "a.b" * n + "@",
            ("me@home.org 10.0.0.1 " + "word " * 50) * (n // 100)]


def test_runs_equal_brute_force(spark):
    check_base(numbered(spark.createDataFrame([(1, t) for t in long_runs(1500)], "doc_id long, text string")))


def test_long_runs_end(spark):
    """Neither the stack nor the time gives out on long runs (the plain patterns go back over them again and again)."""
    n = 60_000
    rows = list(enumerate(long_runs(n)))
    got = {r["doc_id"]: r for r in P.digest(P.personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got[0]["spans"] == f"email:0:{3 + 2 * n}"
    assert [got[i]["n_email"] for i in range(10)] == [1, 0, 0, 0, 0, 0, 0, n, 0, n // 100]
    assert got[9]["n_ip"] == n // 100 and got[6]["n_ip"] == n // 4


def test_base_on_edges(edge_docs, no_docs):
    check_base(numbered(edge_docs.coalesce(1).sortWithinPartitions("text")))
    got = P.digest(P.personal_data(no_docs))
    assert got.count() == 0 and got.columns[:6] == ["doc_id", *(f"n_{k}" for k in PLAIN), "base_sha256"]
    rows = sorted((r["doc_id"] or -1, r["spans"]) for r in P.digest(P.personal_data(edge_docs)).collect())
    assert rows == sorted((r["doc_id"] or -1, ",".join(base_spans(r["text"]))) for r in edge_docs.collect())


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(2, 9)))
    say = lambda n: " ".join(word() for _ in range(n))
    rows, wanted, clean = [], {}, set()

    def put(parts, spans):
        i = len(rows)
        text, marks = say(12) + " ", []
        for part, kind in zip(parts, spans, strict=True):
            if kind:
                marks.append(f"{kind}:{len(text)}:{len(text) + len(part)}")
            text += part + " " + say(6) + " "
        rows.append((i, text))
        return i, marks
    for _ in range(150):                               # plain cases, and decoys that fail the checks
        d = "".join(rng.choice("0123456789") for _ in range(7))
        put([f"{word()}.{word()}@{word()}.com", f"{rng.randrange(256)}.{rng.randrange(256)}.3.{rng.randrange(256)}", card(rng),
             f"+1 (555) {d[:3]}-{d[3:]}"], [None] * 4)
        i, _ = put([card(rng)[:-1] + "x", "300.400.5.6", f"{rng.randrange(1000, 9999)}"], [None] * 3)
    for _ in range(12):
        d = "".join(rng.choice("0123456789") for _ in range(7))
        c = card(rng)
        i, marks = put([f"{word()}.{word()} (at) {word()} (dot) com", f"10[.]{rng.randrange(256)}[.]3[.]44",
                        ".".join(c[j:j + 4] for j in range(0, 16, 4)), f"(555) {d[:3]}-{d[3:]}"], ["email", "ip", "card", "phone"])
        wanted[i] = marks
        i, _ = put(["2024-03-17", "17.03.2024", "3.14", "12:30:45", "1,234.50", str(int(c) + 1), "at home. Then", "dot"], [None] * 8)
        clean.add(i)
        i, _ = put([say(40)], [None])
        clean.add(i)
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3), wanted, clean


def test_learnt_spans_find_rewritten_data_and_leave_the_rest(planted):
    docs, wanted, clean = planted
    got = {r["doc_id"]: r for r in P.digest(P.personal_data(docs)).collect()}
    marks = [m in got[i]["spans"].split(",") for i, ms in wanted.items() for m in ms]
    assert sum(marks) >= 0.9 * len(marks)
    assert sum(got[i]["n_added"] for i in clean) == 0


def test_the_trees_decide(planted, monkeypatch):
    """Without the model nothing is added: what is added beyond the base is the trees' choice."""
    docs, wanted, _ = planted
    monkeypatch.setattr(P.SpanModel, "score", lambda self, x: F.lit(0.0))
    assert P.digest(P.personal_data(docs)).agg(F.sum("n_added")).first()[0] == 0


def test_redacted_text(planted):
    docs, wanted, _ = planted
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in P.redacted(P.personal_data(docs, keep_text=True)).collect():
        text, at, out = rows[r["doc_id"]], 0, ""
        for s in sorted([*r["base"], *r["added"]], key=lambda s: (s["from"], s["kind"])):
            if s["from"] >= at:
                out += text[at:s["from"]] + f"[{P.KINDS[s['kind']].upper()}]"
            at = max(at, s["to"])
        assert r["text"] == out + text[at:]


def test_overlapping_proposals(spark):
    spans = [(0, 0, 10, 0.9), (5, 1, 12, 0.8), (11, 2, 20, 0.7), (30, 0, 35, 0.5), (30, 3, 36, 0.5), (40, 1, 41, 0.1)]
    kind = "array<struct<from:bigint,kind:int,to:bigint,score:double>>"
    got = spark.createDataFrame([(spans,), ([],)], f"s {kind}").select(P._best(F.col("s")).alias("s")).collect()
    # the second loses to the first, and still beats the third: a span is kept only if nothing that overlaps it is better
    assert [(s["from"], s["kind"]) for s in got[0]["s"]] == [(0, 0), (30, 3), (40, 1)] and got[1]["s"] == []


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [([rng.randrange(9) for _ in range(n)],) for n in (0, 1, 2, 3, 4, 5, 15, 16, 17, 100, 1001)]
    for values, sums in spark.createDataFrame(rows, "v array<bigint>").select("v", P.running_sums(F.col("v"))).collect():
        total, out = 0, []
        for v in values:
            total += v
            out.append(total)
        assert sums == out


def test_no_python_in_the_plans(planted):
    docs, _, _ = planted
    out = P.digest(P.personal_data(docs))
    for df in (out, P.matches(docs, "doc_id", "text"), P.examples(P.matches(docs, "doc_id", "text"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_examples_of_all_base_matches(spark):
    """20,500 failed matches give 20,500 examples: none are left out, whatever their number."""
    span = "named_struct('kind', 2, 'value', cast(id + 1000 as string), 'before', '', 'after', '', 'from', 0L, 'to', 4L, 'ok', false)"
    table = spark.range(20_500).selectExpr(f"array({span}) AS base")
    assert P.examples(table).select("value").distinct().count() == 20_500
