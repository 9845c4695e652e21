"""Operator 3: personal data, by DataFrame functions only.

Generators propose spans with high recall: addresses, network addresses, card
and telephone numbers in their written forms (the base spans, kept when their
form is valid), and beside them spelled-out addresses, account numbers and
bare numbers, which may overlap.  Each further candidate gets features of its
format and of the text before it; boosted trees score it, a logistic curve
calibrates the score, and a threshold for each kind selects what is redacted.

Everything on the path of the rows is a built-in expression: no shuffle, no
Python.  A pattern's matches and the text between them come from
``regexp_extract_all`` and ``split``, and their lengths give the offsets (code
points, ends exclusive).  The trees are fitted on the driver to a table of
written examples of TRAIN rows, made by expressions of a row number.

Null texts count as empty and have no spans; repeated rows are scanned each.
Added columns replace present ones of the same name.
"""

from __future__ import annotations

import functools

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The written forms. Possessive quantifiers and the look-behind
# keep the leftmost matches and rule out rescans of long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
SPELLED = r"[A-Za-z0-9._%+-]{1,64}+\s?[(\[]\s?(?i:at)\s?[)\]]\s?[A-Za-z0-9-]{1,63}+(?:\s?[(\[]\s?(?i:dot)\s?[)\]]\s?[A-Za-z0-9-]{1,63}+)++"
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
NUMBER = r"(?<![0-9A-Za-z+.])\(?[0-9](?:[\x20()./-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])"

BASE = ("email", "ip", "card", "phone")
EXTRA = ("spelled", "account", "number")

#: Rows of the table of examples, trees, and the precision that a kind's threshold must have on held-out examples.
TRAIN = 4_000
TREES = 30
PRECISION = 0.99
#: Code points of the text before a candidate that are looked at.
CONTEXT = 40

FEATURES = {
    "digits": "length(regexp_replace(x.s, '[^0-9]', ''))",
    "letters": "length(regexp_replace(x.s, '[^A-Za-z]', ''))",
    "groups": "size(split(x.s, '[^0-9A-Za-z]+'))",
    "person_form": "int(x.s rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$')",
    "phone_form": r"int(x.s rlike '^\\(?[0-9]{3}\\)?[ .-]{1,2}[0-9]{3}[ .-][0-9]{4}$')",
    "date_form": "int(x.s rlike '^(?:19|20)[0-9]{2}[-/.][0-9]{2}[-/.][0-9]{2}' or x.s rlike '^[0-9]{2}[-/.][0-9]{2}[-/.](?:19|20)[0-9]{2}')",
    "account_form": "int(x.s rlike '^[A-Z]{2}[0-9]{2}')",
    "spelled_form": r"int(x.s rlike '[(\\[]\\s?(?i:at)\\s?[)\\]]')",
    "identity_before": "int(x.ctx rlike '(?i)(?:ssn|social security|tax (?:id|number)|passport|licen[cs]e (?:no|number)|national id|account|iban)')",
    "phone_before": r"int(x.ctx rlike '(?i)(?:phone|mobile|\\bcell|\\btel\\b|\\bcall|\\bfax)')",
    "serial_before": "int(x.ctx rlike '(?i)(?:order|invoice|version|serial|item|part|isbn|ref|sku|build)')",
}


def _spans(text: Column, pattern: str, gate: Column) -> Column:
    """array of (start, stop, s, ctx) of the pattern's matches; rows outside the gate cost no scan."""
    kind = "array<struct<start:bigint,stop:bigint,s:string,ctx:string>>"
    none = F.array().cast(kind)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["0"])
        stop = start + F.length(x["1"])
        span = F.struct(start.alias("start"), stop.alias("stop"), x["1"].alias("s"), F.right(x["0"], F.lit(CONTEXT)).alias("ctx"))
        return F.when(x["1"].isNull(), acc).otherwise(F.struct(stop.alias("at"), F.array_append(acc["out"], span).alias("out")))

    # matches are gathered a block at a time, as an appended array is copied: blocks of about the root of their number
    def block(acc: Column, part: Column) -> Column:
        found = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.transform(F.array(found), lambda f: F.struct(f["at"].alias("at"), F.array_append(acc["out"], f["out"]).alias("out")))[0]

    def gathered(z: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(z) + 1)).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / width).cast("int")), lambda k: F.slice(z, k * width + 1, width))
        zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))
        return F.aggregate(parts, zero, block, lambda acc: F.flatten(acc["out"]))

    zipped = F.arrays_zip(F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    return F.when(gate, F.transform(F.array(zipped), gathered)[0]).otherwise(none)


def _luhn(digits: Column) -> Column:
    """Whether the string of digits has a valid check digit."""
    turned = F.split(F.reverse(digits), "")
    doubled = F.transform(turned, lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _card(x: Column) -> Column:
    d = _digits(x["s"])
    return F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False)


def _examples(spark: SparkSession) -> DataFrame:
    """(s, ctx, y, fold): written examples and counterexamples, all expressions of a row number."""
    d = lambda k, n: f"lpad(cast(pmod(xxhash64(id, {k}), {10**n}) as string), {n}, '0')"
    pick = lambda k, *options: f"element_at(array({', '.join(repr(o) for o in options)}), cast(pmod(xxhash64(id, {k}), {len(options)}) as int) + 1)"
    identity = pick(50, "my ssn is ", "social security number: ", "tax id ", "passport no. ", "account number ", "national id: ")
    phone = pick(51, "call me at ", "phone: ", "tel ", "mobile ", "fax: ", "my cell is ")
    serial = pick(52, "order ", "invoice no ", "version ", "serial ", "item ", "isbn ", "ref: ", "build ")
    neutral = pick(53, "and then ", "it was ", "the ", "in all ", "about ", "with ", "of them, ", "")
    word = pick(54, "john.doe", "m_smith", "anna", "info", "k.lee99", "sales-team")
    host = pick(55, "example", "mail", "corp-net", "uni")
    forms = [
        (f"concat({d(1, 3)}, '-', {d(2, 2)}, '-', {d(3, 4)})", f"if(pmod(id, 3) = 0, {neutral}, {identity})", 1),
        (f"concat('(', {d(1, 3)}, ') ', {d(2, 3)}, '-', {d(3, 4)})", f"if(pmod(id, 3) = 0, {neutral}, {phone})", 1),
        (f"concat({d(1, 3)}, '-', {d(2, 3)}, '-', {d(3, 4)})", f"if(pmod(id, 3) = 0, {neutral}, {phone})", 1),
        (d(1, 9), identity, 1),
        (d(1, 10), phone, 1),
        (f"concat({word}, ' (at) ', {host}, ' (dot) com')", neutral, 1),
        (f"concat('DE', {d(1, 2)}, ' ', {d(2, 4)}, ' ', {d(3, 4)}, ' ', {d(4, 4)}, ' ', {d(5, 4)})", f"if(pmod(id, 2) = 0, {neutral}, {identity})", 1),
        (d(1, 9), f"if(pmod(id, 2) = 0, {neutral}, {serial})", 0),
        (f"concat({d(1, 8)}, {d(2, 8)})", f"if(pmod(id, 2) = 0, {neutral}, {serial})", 0),
        (f"concat({d(1, 7)}, if(pmod(id, 2) = 0, '', {d(2, 5)}))", f"if(pmod(id, 3) = 0, {serial}, {neutral})", 0),
        (f"concat('20', {d(1, 2)}, '-0', {d(2, 1)}, '-1', {d(3, 1)})", neutral, 0),
        (f"concat({d(1, 1)}, '.', {d(2, 2)}, '.', {d(3, 2)}, '.', {d(4, 4)})", f"if(pmod(id, 3) = 0, {neutral}, {serial})", 0),
        (f"concat({d(1, 3)}, ' ', {d(2, 3)}, ' ', {d(3, 3)})", f"if(pmod(id, 3) = 0, {serial}, {neutral})", 0),
        (f"concat({d(1, 3)}, '-', {d(2, 4)}, '-', {d(3, 3)})", serial, 0),
    ]
    form = f"pmod(xxhash64(id, 99), {len(forms)})"
    case = lambda k: "case " + " ".join(f"when form = {i} then {f[k]}" for i, f in enumerate(forms)) + " end"
    rows = spark.range(TRAIN).selectExpr("id", f"{form} as form")
    return rows.selectExpr("form", f"named_struct('s', {case(0)}, 'ctx', {case(1)}) as x", f"{case(2)} as y", "pmod(xxhash64(id, 98), 3) as fold")


def _fit_tree(x: np.ndarray, slope: np.ndarray, curve: np.ndarray, depth: int):
    """A regression tree on gradients: (feature, limit, below, above), or a leaf's value."""
    value = float(slope.sum() / (curve.sum() + 1.0))
    if depth == 0:
        return value
    best, gain = None, 1e-6
    for f in range(x.shape[1]):
        for limit in np.unique(x[:, f])[:-1]:
            low = x[:, f] <= limit
            got = sum(slope[m].sum() ** 2 / (curve[m].sum() + 1.0) for m in (low, ~low)) - slope.sum() ** 2 / (curve.sum() + 1.0)
            if got > gain:
                best, gain = (f, float(limit), low), got
    if best is None:
        return value
    f, limit, low = best
    return f, limit, _fit_tree(x[low], slope[low], curve[low], depth - 1), _fit_tree(x[~low], slope[~low], curve[~low], depth - 1)


def _tree_value(tree, row) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def _tree_sql(tree) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    name = list(FEATURES)[tree[0]]
    return f"if(x.{name} <= {tree[1]!r}D, {_tree_sql(tree[2])}, {_tree_sql(tree[3])})"


@functools.cache
def _model(app: str) -> tuple[str, float]:
    """SQL of the calibrated score of a candidate ``x`` with features, and the threshold; fitted once per application."""
    spark = SparkSession.active()
    rows = _examples(spark).select("y", "fold", *[F.expr(sql).alias(name) for name, sql in FEATURES.items()]).collect()
    x = np.array([[r[f] for f in FEATURES] for r in rows], float)
    y = np.array([r["y"] for r in rows], float)
    held = np.array([r["fold"] for r in rows]) == 0
    total = np.zeros(len(y))
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        fit = ~held
        tree = _fit_tree(x[fit], (y - p)[fit], (p * (1 - p))[fit], 2)
        trees.append(tree)
        total += 0.5 * np.array([_tree_value(tree, r) for r in x])
    # calibration and the threshold, on examples the trees haven't seen
    from .common import Logistic

    curve = Logistic(total[held].reshape(-1, 1), y[held], ridge=1e-2)
    p = curve(total[held].reshape(-1, 1))
    marks = np.unique(p)
    good = [t for t in marks if y[held][p >= t].mean() >= PRECISION]
    a = curve.weights[0] / curve.scale[0]
    b = curve.weights[1] - curve.mean[0] * a
    sum_sql = " + ".join(f"0.5D * {_tree_sql(t)}" for t in trees)
    return f"1.0D / (1.0D + exp(-({a!r}D * ({sum_sql}) + {b!r}D)))".replace("np.float64(", "").replace(")D", "D"), float(min(good, default=1.0))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``n_extra``, ``base_sha256`` and ``spans``."""
    score, threshold = _model(docs.sparkSession.sparkContext.applicationId)
    added = ["n_email", "n_ip", "n_card", "n_phone", "n_extra", "base_sha256", "spans"]
    rest = [c for c in docs.columns if c not in added]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digits = t.rlike("[0-9]")
    found = docs.select(
        *[F.col(f"`{c}`") for c in rest],
        _spans(t, EMAIL, t.contains("@")).alias("_email"),
        _spans(t, IP, t.rlike(r"[0-9]\.[0-9]")).alias("_ip"),
        _spans(t, CARD, t.rlike("[0-9][ -]?[0-9]")).alias("_card"),
        _spans(t, PHONE, t.contains("+")).alias("_phone"),
        _spans(t, SPELLED, t.rlike(r"(?i)[(\[]\s?at\s?[)\]]")).alias("_spelled"),
        _spans(t, ACCOUNT, t.rlike("[A-Z]{2}[0-9]{2}")).alias("_account"),
        _spans(t, NUMBER, digits).alias("_number"),
    )
    valid = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["s"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": _card,
        "phone": lambda x: F.length(_digits(x["s"])).between(8, 15),
    }
    names = ", ".join(f"'{name}', double({sql})" for name, sql in FEATURES.items())
    base = found.select(*[F.col(f"`{c}`") for c in rest], *[F.filter(f"_{k}", valid[k]).alias(f"_{k}") for k in BASE], *[f"_{k}" for k in EXTRA])
    taken = F.concat(*[F.col(f"_{k}") for k in BASE])
    base = base.select("*", taken.alias("_taken"))
    for k in EXTRA:
        free = F.expr(f"filter(_{k}, y -> not exists(_taken, z -> z.start < y.stop and y.start < z.stop))")
        base = base.withColumn(f"_{k}", free)
        base = base.withColumn(f"_{k}", F.expr(f"transform(_{k}, x -> named_struct('start', x.start, 'stop', x.stop, {names}))"))
        base = base.withColumn(f"_{k}", F.expr(f"filter(_{k}, x -> {score} >= {threshold!r}D)"))
    listed = lambda kinds: F.concat(*[F.expr(f"transform(_{k}, x -> concat('{k}:', x.start, ':', x.stop))") for k in kinds])
    return base.select(
        *[F.col(f"`{c}`") for c in rest],
        *[F.size(f"_{k}").cast("bigint").alias(f"n_{k}") for k in BASE],
        F.expr(" + ".join(f"size(_{k})" for k in EXTRA)).cast("bigint").alias("n_extra"),
        F.sha2(F.array_join(listed(BASE), ","), 256).alias("base_sha256"),
        F.array_join(listed((*BASE, *EXTRA)), ",").alias("spans"),
    )
