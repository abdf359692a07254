"""Operator 11: personal data by boosted trees over candidate spans, with SQL functions only.

1. Base: spans of the four kinds by fixed patterns and checks (``BASE``, ``_valid``). They are always kept.
2. Candidates: looser patterns of each kind (``LOOSE``: addresses written out with "at" and "dot" or spaced, hosts without a
   dot or in other scripts, defanged and longer addresses of machines, card numbers cut out of longer rows of digits or with
   other separators, telephone numbers without a plus) propose spans, which may overlap between the kinds. They are looked
   for where no base span is.
3. Features: format (digits, groups, separators, checksum, ranges, last label) and context (touching characters, cue words
   before the span). Spans are short, so features are SQL functions over arrays within the row.
4. Training without labels: base matches that pass their check are examples of personal data, those that fail are not.
   Both are rewritten as the loose patterns would meet them (plus sign dropped, "(at)", other separators) or spoilt
   (checksum broken, part out of range, cut to a date or a plain number). All base matches are taken. One half trains gradient-boosted trees, the other calibrates: a kind's threshold is the lowest score
   at and above which ``PRECISION`` of its calibration examples are personal data (a failure is added to what is seen, so
   that few examples prove nothing).
5. The trees become SQL expressions. A candidate at its threshold or above is added unless one that overlaps it has a
   better score.

Texts are read once; matches, candidates and 40 characters before each go to the shared folder, without the texts, so a lost
executor repeats only its own part. Nothing is shuffled by document. Positions are sums of the lengths of the text between
matches, in two levels of blocks, so the work grows with the text and not with its square. Regular expressions use
possessive groups, so neither long runs nor many repetitions recurse or go back over them.

Cases: null texts are empty; empty texts have no spans; a null id stays null; repeated rows give a row each; without base
matches of both labels nothing is added; the noncharacter U+FDD0 stands for covered text while candidates are looked for; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KINDS = ["email", "ip", "card", "phone"]
#: Patterns of the base spans (fixed values): each equals the plain pattern, but does not go back over long runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_DOT = r"(?:\[\.\]|\(\.\)|[\[({<]dot[\])}>]|\x20dot\x20)"
_AT = r"(?:[\[({<]at[\])}>]|＠)"
LOOSE = {
    "email": r"(?i)(?<![\p{L}\p{N}._%+'-])[\p{L}\p{N}._%+'-]{1,64}+(?:"
             r"@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){0,5}+"
             rf"|\s{{0,2}}+(?:{_AT}|@)\s{{0,2}}+[\p{{L}}\p{{N}}-]{{1,63}}+(?:\s{{0,2}}(?:\.|{_DOT})\s{{0,2}}[\p{{L}}\p{{N}}-]{{1,63}}+){{1,5}}+"
             rf"|\x20at\x20[\p{{L}}\p{{N}}-]{{1,63}}+(?:\s{{0,2}}{_DOT}\s{{0,2}}[\p{{L}}\p{{N}}-]{{1,63}}+){{1,5}}+)",
    "ip": rf"(?i)(?<![0-9A-Za-z.:])(?:[0-9]{{1,3}}(?:\s?{_DOT}\s?[0-9]{{1,3}}){{3}}"
          r"|(?:[0-9A-F]{1,4}:){7}[0-9A-F]{1,4}|(?:[0-9A-F]{1,4}:){1,6}(?::[0-9A-F]{1,4}){1,6})(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}(?:[\x20./_–-]?[0-9]{4}){2}[\x20./_–-]?[0-9]{1,7}(?![0-9A-Za-z])"
            r"|(?<![0-9A-Za-z])[0-9]{4}[\x20./_–-]?[0-9]{6}[\x20./_–-]?[0-9]{5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,/:-])(?:\+|00)?\x20?\(?[0-9]{1,4}\)?(?:[\x20./‑–-]{1,2}\(?[0-9]{2,5}\)?){1,5}(?![0-9A-Za-z])",
}
#: Cheap signs without which a loose pattern cannot match.
SIGNS = {
    "email": r"(?i)[@＠]|[\[({<]at[\])}>]|\x20at\x20\S+\x20?[\[({<\x20]dot",
    "ip": r"(?i)[0-9]\s?[\[({<\x20](?:\.|dot)|[0-9A-F]:[0-9A-F:]",
    "card": r"[0-9]{4}[\x20./_–-]?[0-9]{4}",
    "phone": r"[0-9]\)?[\x20./‑–-]{1,2}\(?[0-9]{2}",
}
#: Words before a span that speak for its kind, and words that speak against personal data.
CUES = {
    "email": r"(?i)(?:e-?mail|mail|contact|write|reach|correo|courriel|kontakt)\W*(?:\w+\W+)?$",
    "ip": r"(?i)(?:ip|address|host|server|client|adresse|from)\W*(?:\w+\W+)?$",
    "card": r"(?i)(?:card|visa|amex|master\s?card|credit|karte|tarjeta|carte)\W*(?:\w+\W+)?$",
    "phone": r"(?i)(?:tel|phone|telephone|call|fax|mobile|cell|telefon|téléphone|teléfono|handy)\W*(?:\w+\W+)?$",
}
AGAINST = r"(?i)(?:order|invoice|ref|no|nr|id|isbn|issn|doi|version|v|build|page|pages|date|eur|usd|\$|€)\W*$"
IN_RANGE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"
FILL = "\ufdd0"
#: Characters kept before and after a span, and of a span itself, for its features.
CONTEXT, VALUE = 40, 300
SEED = 11
ROUNDS, DEPTH, STEP = 25, 4, 0.2
PRECISION = 0.95
#: No loose span is longer than this, none shorter than 4 characters, so no more of them overlap one.
NEIGHBOURS = 512
FEATURES = ["kind", "digits", "signs", "groups", "longest", "shortest", "luhn", "in_range", "last_label", "labels", "touches_before",
            "touches_after", "cue", "against", "issuer", "brackets", "international", "value_length"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the Luhn check."""
    def check(pair: Column) -> Column:
        at = F.sequence(F.lit(1), F.lit(19))
        digit = lambda i: F.substring(F.get(pair, (i + 1) % 2), i, F.lit(1)).cast("int")
        return F.aggregate(at, F.lit(0), lambda total, i: total + digit(i)) % 10 == 0
    padded = F.lpad(F.substring(digits, 1, 19), 19, "0")
    return let(F.array(padded, F.translate(padded, "0123456789", "0246813579")), check)


def _valid(kind: str, value: Column) -> Column:
    """The check of a base match."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return value.rlike(IN_RANGE)
    if kind == "card":
        return let(_digits(value), lambda d: F.length(d).between(14, 19) & luhn(d))
    return F.length(_digits(value)).between(10, 15)


def running_sums(values: Column) -> Column:
    """The running sums of an array of whole numbers, by blocks of about the square root of its size."""
    step = F.greatest(F.ceil(F.sqrt(F.size(values))), F.lit(1)).cast("int")
    last = F.floor((F.size(values) - 1) / step).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(values, b * step + 1, step))
    add = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    sums = lambda xs, start: F.aggregate(xs, F.array(start), add)
    zero = F.lit(0).cast("long")
    whole = lambda xs: F.aggregate(xs, zero, lambda a, x: a + x)
    before = F.slice(sums(F.transform(blocks, whole), zero), F.lit(1), last + 1)
    parts = F.zip_with(blocks, before, lambda xs, start: F.slice(sums(xs, start), F.lit(2), F.size(xs)))
    return F.when(F.size(values) > 0, F.flatten(parts)).otherwise(F.array().cast("array<bigint>"))


def found(rows: DataFrame, text: str, pattern: str, out: str, sign: Column) -> DataFrame:
    """Add the column ``out`` with the matches of the pattern in a text column: from, to, value, before, after."""
    m, p, at = f"_{out}_m", f"_{out}_p", f"_{out}_to"
    kind = "array<struct<from:bigint,to:bigint,value:string,before:string,after:string>>"
    rows = rows.withColumn(m, F.when(sign, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(
        F.array().cast("array<string>")))
    rows = rows.withColumn(p, F.when(F.size(m) > 0, F.split(text, pattern, -1)).otherwise(F.array().cast("array<string>")))
    ends = running_sums(F.transform(F.col(m), lambda x, i: (F.length(F.get(p, i)) + F.length(x)).cast("long")))
    rows = rows.withColumn(at, F.when(F.size(m) > 0, ends).otherwise(F.array().cast("array<bigint>")))
    spans = F.transform(F.col(m), lambda x, i: F.struct(
        (F.get(at, i) - F.length(x)).alias("from"), F.get(at, i).alias("to"), x.alias("value"),
        F.right(F.get(p, i), F.lit(CONTEXT)).alias("before"), F.left(F.get(p, i + 1), F.lit(CONTEXT)).alias("after")))
    return rows.withColumn(out, F.when(F.size(m) > 0, spans).otherwise(F.array().cast(kind))).drop(m, p, at)


def covered(text: Column, pattern: str, kind: str) -> Column:
    """The text with the valid matches of a base pattern covered up, at its old length."""
    parts = F.split(text, pattern, -1)
    hits = F.concat(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.array(F.lit("")))
    return F.array_join(F.zip_with(parts, hits, lambda gap, hit: F.concat(
        gap, F.when(_valid(kind, hit), F.repeat(F.lit(FILL), F.length(hit))).otherwise(hit))), "")


def _named(spans: str, number: int, kind: str | None = None) -> Column:
    """The spans with the number of their kind, short values, and (for base matches) whether they pass their check."""
    def one(s: Column) -> Column:
        ok = _valid(kind, s["value"]) if kind else F.lit(False)
        return F.struct(s["from"].alias("from"), F.lit(number).alias("kind"), s["to"].alias("to"),
                        F.substring(s["value"], 1, VALUE).alias("value"), s["before"].alias("before"),
                        s["after"].alias("after"), ok.alias("ok"))
    return F.transform(F.col(spans), one)


def _of_kind(number: int):
    return lambda s: s["kind"] == number


def _valid_one(number: int):
    return lambda s: s["ok"] & (s["kind"] == number)


def matches(docs: DataFrame, id_col: str, text_col: str, keep_text: bool = False) -> DataFrame:
    """doc_id, base, loose (and text): base matches and loose candidates of every text, as arrays of spans."""
    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    signs = {"email": F.col("text").contains("@"), "ip": F.col("text").rlike(r"[0-9]\.[0-9]"),
             "card": F.col("text").rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.col("text").contains("+")}
    for kind in KINDS:
        rows = found(rows, "text", BASE[kind], f"base_{kind}", signs[kind])
    rows = rows.withColumn("base", F.concat(*(_named(f"base_{k}", i, k) for i, k in enumerate(KINDS)))).drop(
        *(f"base_{k}" for k in KINDS))
    rows = rows.withColumn("rest", F.col("text"))
    for i, kind in enumerate(KINDS):
        here = F.exists("base", _valid_one(i))
        rows = rows.withColumn("rest", F.when(here, covered(F.col("rest"), BASE[kind], kind)).otherwise(F.col("rest")))
    for kind in KINDS:
        rows = found(rows, "rest", LOOSE[kind], f"loose_{kind}", F.col("rest").rlike(SIGNS[kind]))
    return rows.select("doc_id", "base", F.concat(*(_named(f"loose_{k}", i) for i, k in enumerate(KINDS))).alias("loose"),
                       *(["text"] if keep_text else []))


def features(span: Column) -> Column:
    """The numbers in the order of FEATURES, as an array, of a span with kind, value, before and after."""
    kind, value = span["kind"], span["value"]
    joined = F.regexp_replace(F.lower(value), rf"\s*(?:{_DOT}|\.)\s*", ".")
    parts = F.struct(_digits(value).alias("digits"), F.transform(F.array_remove(F.split(value, "[^0-9]+"), ""), F.length).alias("groups"),
                     joined.alias("joined"), F.regexp_replace(joined, rf"\s*(?:{_AT}|\x20at\x20|@)\s*", "@").alias("mail"))
    cue = reduce(lambda a, b: a | b, [(kind == i) & span["before"].rlike(CUES[k]) for i, k in enumerate(KINDS)])
    is_mail = kind == KINDS.index("email")
    yes = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    number = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))

    def numbers(s: Column) -> Column:
        digits, groups, plain = s["digits"], s["groups"], s["mail"]
        return F.array(
            number(kind), number(F.length(digits)), number(F.length(F.regexp_replace(value, r"[\p{L}\p{N}]", ""))),
            number(F.size(groups)), number(F.array_max(groups)), number(F.array_min(groups)),
            yes(F.length(digits).between(13, 19) & luhn(digits)), yes(s["joined"].rlike(IN_RANGE)),
            number(F.when(is_mail, F.length(F.regexp_extract(plain, r"\.(\p{L}{2,24})$", 1)))),
            number(F.when(is_mail, F.size(F.split(F.substring_index(plain, "@", -1), r"\.")))),
            yes(span["before"].rlike(r"[\p{L}\p{N}]$")), yes(span["after"].rlike(r"^[\p{L}\p{N}]")), yes(cue),
            yes(span["before"].rlike(AGAINST)), yes(digits.rlike("^[3-6]")), yes(value.rlike(r"[()]")),
            yes(value.rlike(r"^(?:\+|00)")), number(F.length(value)))
    return let(parts, numbers)


def examples(table: DataFrame) -> DataFrame:
    """kind, value, before, after, label, part: all base matches, rewritten and spoilt."""
    seeds = table.select(F.explode("base").alias("s")).select("s.*")
    seeds = seeds.orderBy(F.xxhash64(F.lit(SEED), "value", "before", "after", "from"), "value", "from")
    value, digits = F.col("value"), _digits(F.col("value"))
    kind = {k: F.col("kind") == i for i, k in enumerate(KINDS)}
    four = F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2), F.lit("-"), F.substring(digits, 7, 2))
    last = F.translate(F.right(value, F.lit(1)), "0123456789", "1234567890")
    good = {
        "email": [value, F.regexp_replace(F.regexp_replace(value, "@", " (at) "), r"\.", " (dot) "),
                  F.regexp_replace(F.regexp_replace(value, "@", " at "), r"\.", " dot "),
                  F.regexp_replace(F.regexp_replace(value, "@", " @ "), r"\.", " . ")],
        "ip": [value, F.regexp_replace(value, r"\.", "[.]"), F.regexp_replace(value, r"\.", " dot ")],
        "card": [value, F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1."), F.regexp_replace(digits, "([0-9]{4})(?=[0-9])", "$1/"), digits],
        "phone": [value, F.regexp_replace(value, r"^\+[0-9]+[\x20.-]*", ""), F.regexp_replace(value, r"^\+", "00"),
                  F.regexp_replace(value, r"^\+", "")]}
    bad = {
        "email": [F.regexp_replace(value, r"@([A-Za-z0-9-]+).*$", "@$1"), F.regexp_replace(value, "@.*$", " @ 5.50"),
                  F.regexp_replace(value, r"@.*$", " @ 12 . 5")],
        "ip": [F.regexp_replace(value, r"^[0-9]+", "300"), F.regexp_replace(F.regexp_replace(value, r"^[0-9]+", "704"), r"\.", "[.]")],
        "card": [F.concat(F.left(value, F.length(value) - 1), last), F.regexp_replace(F.concat(F.left(digits, F.length(digits) - 1), last),
                 "([0-9]{4})(?=[0-9])", "$1.")],
        "phone": [digits, four, F.concat(F.substring(digits, 1, 2), F.lit("."), F.substring(digits, 3, 2), F.lit("."), F.substring(digits, 5, 4)),
                  F.concat(F.substring(digits, 1, 3), F.lit("."), F.substring(digits, 4, 3)), F.substring(digits, 1, 10),
                  F.concat(F.substring(digits, 1, 4), F.lit(" "), F.substring(digits, 5, 4))]}

    def made(forms: dict, label: int) -> Column:
        pick = F.lit(None).cast("array<string>")
        for k in KINDS:
            pick = F.when(kind[k], F.array(*forms[k])).otherwise(pick)
        return F.transform(pick, lambda v: F.struct(v.alias("value"), F.lit(label).alias("label")))
    forms = F.when(F.col("ok"), F.concat(made(good, 1), made(bad, 0))).otherwise(F.array(F.struct(value.alias("value"), F.lit(0).alias("label"))))
    part = F.pmod(F.xxhash64(F.lit(SEED + 1), "value"), F.lit(4)).alias("part")
    rows = seeds.select("kind", "before", "after", part, F.explode(forms).alias("f"))
    return rows.select("kind", "f.value", "before", "after", F.col("f.label").cast("double").alias("label"), "part")


def _tree(node, x: Column) -> Column:
    """A tree of the fitted model as an SQL expression over the array of features."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(F.get(x, F.lit(int(split.featureIndex()))) <= F.lit(float(split.threshold())), _tree(node.leftChild(), x)).otherwise(
        _tree(node.rightChild(), x))


class SpanModel:
    """Boosted trees over span features with a threshold for each kind; without both labels it adds nothing."""

    def __init__(self, table: DataFrame):
        span = F.struct("kind", "value", "before", "after")
        rows = examples(table).select("kind", "label", "part", features(span).alias("x"))
        rows = written(rows.select("kind", "label", "part", *(F.get("x", F.lit(i)).alias(f"x{i}") for i in range(len(FEATURES)))),
                       "personal-examples")
        train, proof = rows.where("part < 2"), rows.where("part >= 2")
        labels = {r["label"] for r in train.select("label").distinct().collect()}
        self.trees, self.thresholds = [], dict.fromkeys(range(len(KINDS)), 2.0)
        if len(labels) < 2:
            return
        columns = [f"x{i}" for i in range(len(FEATURES))]
        model = GBTClassifier(labelCol="label", featuresCol="x", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=STEP, seed=SEED).fit(
            VectorAssembler(inputCols=columns, outputCol="x").transform(train))
        self.trees = list(zip(model.treeWeights, [t._call_java("rootNode") for t in model.trees], strict=True))
        bins = proof.select("kind", "label", F.floor(let(F.array(*columns), self.score) * 100).alias("bin")).groupBy("kind", "bin").agg(
            F.count(F.lit(1)).alias("n"), F.sum("label").alias("good")).collect()
        for kind in range(len(KINDS)):
            n, good = 1, 0
            for r in sorted((r for r in bins if r["kind"] == kind), key=lambda r: -r["bin"]):
                n, good = n + r["n"], good + r["good"]
                if good >= PRECISION * n:
                    self.thresholds[kind] = r["bin"] / 100

    def score(self, x: Column) -> Column:
        if not self.trees:
            return F.lit(0.0)
        total = reduce(lambda a, b: a + b, [F.lit(float(w)) * _tree(t, x) for w, t in self.trees])
        return 1 / (1 + F.exp(-2 * total))

    def selected(self, spans: Column) -> Column:
        """The spans with their score, of those at the threshold of their kind or above."""
        least = F.array(*(F.lit(float(self.thresholds[k])) for k in range(len(KINDS))))
        with_x = F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["kind"].alias("kind"), s["to"].alias("to"),
                                                       features(s).alias("x")))
        scored = F.transform(with_x, lambda s: F.struct(s["from"].alias("from"), s["kind"].alias("kind"), s["to"].alias("to"),
                                                        self.score(s["x"]).alias("score")))
        return F.filter(scored, lambda s: s["score"] >= F.get(least, s["kind"]))


def _best(spans: Column) -> Column:
    """The spans (in order of their start) that no overlapping span beats: by score, then length, start and kind."""
    rank = lambda s: F.struct(s["score"], s["to"] - s["from"], -s["from"], -s["kind"])

    def kept(s: Column, i: Column) -> Column:
        first = F.greatest(i - NEIGHBOURS, F.lit(0)) + 1
        near = F.slice(spans, first, F.lit(2 * NEIGHBOURS + 1))
        return ~F.exists(near, lambda o: (o["from"] < s["to"]) & (o["to"] > s["from"]) & (rank(o) > rank(s)))
    return F.when(F.size(spans) > 1, F.filter(spans, kept)).otherwise(spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, base, added (and text): arrays of spans (from, kind, to) in order, of every row. Kinds are places in KINDS."""
    table = written(matches(docs, id_col, text_col, keep_text), "personal-matches")
    model = SpanModel(table)
    short = lambda spans: F.transform(spans, lambda s: F.struct(s["from"].alias("from"), s["kind"].alias("kind"), s["to"].alias("to")))
    base = F.array_sort(short(F.filter("base", lambda s: s["ok"])))
    rows = table.withColumn("base", base).withColumn("loose", F.array_sort(model.selected(F.col("loose"))))
    return rows.withColumn("added", short(_best(F.col("loose")))).drop("loose")


def listed(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["from"].cast("string"), s["to"].cast("string"))), ",")


def redacted(rows: DataFrame) -> DataFrame:
    """The rows with ``text`` in which every span, or run of overlapping spans, reads [EMAIL], [IP], [CARD] or [PHONE] after
    its first one. The work is the number of spans of a text times its length."""
    marks = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    spans = F.array_sort(F.concat("base", "added"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["from"] - acc["at"]).cast("int"))
        new = F.concat(acc["out"], gap, F.get(marks, s["kind"]))
        return F.struct(F.greatest(acc["at"], s["to"]).alias("at"), F.when(s["from"] >= acc["at"], new).otherwise(acc["out"]).alias("out"))
    text = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return rows.withColumn("text", text)


def digest(rows: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans (all) and n_added."""
    counts = [F.size(F.filter("base", _of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                       listed(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
