"""Personal data: fixed formats, and candidate spans chosen by boosted trees.

Base formats (e-mail, IP, card, phone) are found by regular expressions and
checked. Wider generators propose spans that may overlap them: addresses written
with "(at)", and any run of digits and separators with 7 digits or more. Boosted
trees score every candidate by format (digits, separators, checks) and context
(words before, characters around). They are fitted on all candidates, counted by
features and label; those that touch a base span and those that touch none weigh half each. The label does not
depend on the base spans: an address that is one once "(at)" and "(dot)" are undone, an IP
address, and, free of letters and digits around it, 13 to 19 digits with a valid check
sum, "+" with 8 to 15 digits, or 7 to 15 digits after a telephone word. A
fifth of the candidates, by hash, is held out: the lowest threshold of a grid at which at least
PRECISION of the accepted held-out candidates that touch no base span are right is used,
and without one nothing is added. Accepted candidates that touch no base span are added to the
base spans. The trees become one expression, so scoring needs neither a shuffle
nor Python: all of this is DataFrame expressions and pyspark.ml.

Positions are code points, end exclusive. Defined cases: null and empty texts
have no spans; candidates of one class or fewer than MIN_ROWS give no model
and nothing is added; rows that repeat a doc_id, or have none, are handled one
by one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweave.llm.common import stored, whole_text

KINDS = ("email", "ip", "card", "phone")
MIN_ROWS, TREES, DEPTH = 50, 10, 3
ROWS_PER_TASK = 50_000
PRECISION = 0.995
_GRID = tuple(x / 100 for x in range(50, 100, 5)) + (0.99,)
_SPAN = "array<struct<start:int,end:int,m:string>>"

# The formats are fixed values. Possessive quantifiers and "start of a run or end of the last match" do not
# change what matches; they keep the time linear in long runs.
_LOCAL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++"
_EMAIL = _LOCAL + r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WIDE_EMAIL = _LOCAL + r"(?:@|\x20?[(\[]at[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[]dot[)\]]\x20?)[A-Za-z0-9-]++)++"
_WIDE_NUMBER = r"[+(]?(?<![0-9])[0-9][0-9().\x20/-]{5,}[0-9]"


def _located(text: Column, pattern: str, hint: Column) -> Column:
    """Leftmost non-overlapping matches with their places, from the matches and the gaps between them."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(matches, F.slice(gaps, 1, F.size(matches)), lambda m, g: F.struct(m.alias("m"), F.length(g).alias("g")))
    none = F.array().cast(_SPAN)

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["g"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m"))
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    found = F.aggregate(pairs, F.struct(F.lit(0).alias("pos"), none.alias("out")), step, lambda acc: acc["out"])
    return F.when(hint, found).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Check sum of 13 to 19 digits."""
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, doubled).otherwise(d)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x)
    return F.when(n.between(13, 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", ""))
    return (F.size(parts) == 4) & F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(0)) <= 255))


def _on_match(check: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda s: check(s["m"])


def _of_kind(kind: str) -> Callable[[Column], Column]:
    return lambda s: s["kind"] == kind


def _named(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind"))


def base_spans(text: Column) -> dict[str, Column]:
    """Spans (start, end, m) of each kind that pass its check."""
    has_digit = text.rlike("[0-9]")
    kinds: dict[str, tuple[str, Column, Callable[[Column], Column]]] = {
        "email": (_EMAIL, text.contains("@"), lambda m: F.lit(True)),
        "ip": (_IP, text.rlike(r"[0-9]\.[0-9]"), _octets),
        "card": (_CARD, has_digit, lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m))),
        "phone": (_PHONE, text.contains("+"), lambda m: F.length(_digits(m)).between(8, 15)),
    }
    return {k: F.filter(_located(text, pattern, hint), _on_match(check)) for k, (pattern, hint, check) in kinds.items()}


_ADDRESS = r"^[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}$"
_CONTEXT = ("mail|contact|write to", "tel|phone|call|fax|mobile", "card|visa|credit|pay", r"\bip\b|host|server|address")


def _around(text: Column, s: Column) -> tuple[Column, Column, Column]:
    """What stands before a candidate, the last character of it, and the one after the candidate."""
    before = F.lower(F.substring(text, F.greatest(s["start"] - 23, F.lit(1)), F.least(s["start"], F.lit(24))))
    return before, F.right(before, F.lit(1)), F.substring(text, s["end"] + 1, F.lit(1))


def _is_address(m: Column) -> Column:
    undone = F.regexp_replace(F.regexp_replace(m, r"\x20?[(\[]at[)\]]\x20?", "@"), r"\x20?[(\[]dot[)\]]\x20?", ".")
    return undone.rlike(_ADDRESS)


def _valid(text: Column, s: Column, name: str) -> Column:
    """The label of a candidate, by checks of its own."""
    if name == "email":
        return _is_address(s["m"])
    m, digits = s["m"], _digits(s["m"])
    before, last, after = _around(text, s)
    n = F.length(digits)
    free = ~last.rlike(r"[\p{L}\p{N}]") & ~after.rlike(r"[\p{L}\p{N}]")
    number = _luhn(digits) | (m.startswith("+") & n.between(8, 15)) | (before.rlike(_CONTEXT[1]) & n.between(7, 15))
    return (m.rlike(r"^[0-9.]+$") & _octets(m)) | (free & number)


def _features(text: Column, s: Column) -> Column:
    """Format and context of a candidate as doubles."""
    m, digits = s["m"], _digits(s["m"])
    before, last, after = _around(text, s)
    as_double = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return F.array(
        as_double(F.length(digits)),
        as_double(F.length(m)),
        *[as_double(F.length(m) - F.length(F.replace(m, F.lit(c), F.lit("")))) for c in (".", "-", " ", "/")],
        *[as_double(m.contains(c)) for c in ("+", "(", "@", "[")],
        as_double(_is_address(m)),
        as_double(_luhn(digits)),
        as_double(_octets(m)),
        as_double(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))),
        as_double(last.rlike(r"[\p{L}\p{N}]")),
        as_double(after.rlike(r"[\p{L}\p{N}]")),
        *[as_double(before.rlike(words)) for words in _CONTEXT],
    )


def candidates(text: Column) -> Column:
    """Overlapping candidates of both generators: array of (start, end, kind, x, ok: features and label)."""
    wide = {
        "email": F.filter(_located(text, _WIDE_EMAIL, text.rlike(r"@|[(\[]at[)\]]")), lambda s: F.lit(True)),
        "number": F.filter(_located(text, _WIDE_NUMBER, text.rlike("[0-9]{2}")), lambda s: F.length(_digits(s["m"])) >= 7),
    }

    def kind(name: str, s: Column) -> Column:
        if name == "email":
            return F.lit("email")
        return F.when(_octets(s["m"]), "ip").when(s["m"].startswith("+"), "phone").when(F.length(_digits(s["m"])) >= 13, "card").otherwise("phone")

    def described(name: str) -> Column:
        return F.transform(
            wide[name],
            lambda s: F.struct(
                s["start"].alias("start"), s["end"].alias("end"), kind(name, s).alias("kind"), _features(text, s).alias("x"),
                _valid(text, s, name).alias("ok"),
            ),
        )

    return F.concat(described("email"), described("number"))


def _tree(node, x: Column) -> Column:
    """One fitted tree as a CASE expression."""
    if node.getClass().getSimpleName() == "LeafNode":
        return F.lit(float(node.prediction()))
    split = node.split()
    go_left = F.get(x, F.lit(split.featureIndex())) <= F.lit(float(split.threshold()))
    return F.when(go_left, _tree(node.leftChild(), x)).otherwise(_tree(node.rightChild(), x))


def fit(found: DataFrame) -> tuple[Callable[[Column], Column], float] | None:
    """(score of a feature array as an expression, threshold), or None where nothing can be learned or trusted."""
    rows = found.select("doc_id", "spans", F.explode("candidates").alias("c"))
    touches = F.exists("spans", lambda s: (s["start"] < F.col("c.end")) & (F.col("c.start") < s["end"]))
    key = F.xxhash64("doc_id", "c.start", "c.end")
    held = F.pmod(F.xxhash64(key), F.lit(5)) == 0
    rows = rows.select(F.col("c.x").alias("x"), F.col("c.ok").cast("double").alias("label"), touches.alias("touches"), held.alias("held"))
    # All candidates count; those alike in features and label are one row with their number.
    alike = stored(rows.groupBy("x", "label", "touches", "held").agg(F.count("*").alias("n")), "pii-alike")
    side = F.col("touches") & ~F.col("held"), ~F.col("touches") & ~F.col("held")
    n, right, *sides = alike.agg(F.sum("n"), F.sum(F.col("n") * F.col("label")), *[F.sum(F.when(s, F.col("n"))) for s in side]).first()
    if not n or n < MIN_ROWS or not 0 < right < n:
        return None
    taught = alike.filter(~F.col("held")).withColumn("w", F.col("n") / F.when(F.col("touches"), sides[0]).otherwise(sides[1]) * (sum(k or 0 for k in sides) / 2))
    # In a fixed order: a refit adds up the same rows in the same tasks.
    tasks = max(1, alike.count() // ROWS_PER_TASK)
    dealt = stored(taught.repartition(tasks, "x").sortWithinPartitions("x", "label", "touches").select("label", "w", "x"), "pii-taught")
    trees = GBTClassifier(featuresCol="v", weightCol="w", maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1)
    model = trees.fit(dealt.select("label", "w", array_to_vector("x").alias("v")))
    fitted = list(zip(model._java_obj.trees(), model.treeWeights, strict=True))

    def score(x: Column) -> Column:
        margin = sum((F.lit(float(w)) * _tree(t.rootNode(), x) for t, w in fitted), F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))

    judged = alike.filter("held and not touches").select("label", "n", score(F.col("x")).alias("p"))
    reached = lambda t, c: F.sum(F.when(F.col("p") >= t, c))
    at = judged.agg(*[f for t in _GRID for f in (reached(t, F.col("n")), reached(t, F.col("n") * F.col("label")))]).first()
    for i, t in enumerate(_GRID):
        if at[2 * i] and at[2 * i + 1] >= PRECISION * at[2 * i]:
            return score, t
    return None


_ALL = "array<struct<start:int,end:int,kind:string>>"


def _base(text: Column) -> Column:
    return F.concat(*[F.transform(spans, _named(k)) for k, spans in base_spans(text).items()]).cast(_ALL)


def _chosen(base: str, proposed: str, model) -> Column:
    """Base spans and the accepted candidates that touch none of them, by kind and start."""
    added = F.array().cast(_ALL)
    if model is not None:
        score, threshold = model
        fits = F.filter(
            proposed,
            lambda c: (score(c["x"]) >= threshold)
            & ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"])),
        )
        added = F.transform(fits, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind")))
    place = F.array(*[F.lit(k) for k in KINDS])
    keyed = F.transform(
        F.concat(F.col(base), added),
        lambda s: F.struct(F.array_position(place, s["kind"]).alias("o"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.transform(
        F.array_sort(keyed), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    )


def _proposals(docs: DataFrame) -> DataFrame:
    """Base spans and candidates of every row; the texts themselves go no further."""
    slim = docs.select("doc_id", whole_text(docs).alias("text"))
    text = F.col("text")
    return stored(slim.select("doc_id", _base(text).alias("spans"), candidates(text).alias("candidates")), "pii-candidates")


def find(docs: DataFrame) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, end, kind), by kind and start."""
    found = _proposals(docs)
    return found.select("doc_id", F.col("spans").alias("base"), _chosen("spans", "candidates", fit(found)).alias("spans"))


def _listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    counts = [F.size(F.filter("base", _of_kind(k))).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return find(docs).select(
        "doc_id", *counts, F.sha2(_listed("base").cast("binary"), 256).alias("base_sha256"), _listed("spans").alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, every found span of ``text`` replaced by its kind in angle brackets.

    Spans that overlap or touch are replaced by the mark of the first. A null text stays null. Helper
    columns are longer than any name of ``docs``, so none of its columns is replaced.
    """
    model = fit(_proposals(docs))
    text = whole_text(docs)
    long = "_" * max(len(c) for c in docs.columns)
    base, proposed, found = f"{long}base", f"{long}candidates", f"{long}spans"
    marked = docs.withColumn(base, _base(text)).withColumn(proposed, candidates(text))
    spans = marked.withColumn(found, F.array_sort(_chosen(base, proposed, model)))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("text"), acc["pos"] + 1, F.greatest(s["start"] - acc["pos"], F.lit(0)))
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        grown = F.when(s["start"] < acc["pos"], F.array()).otherwise(F.array(gap, mark))
        return F.struct(F.greatest(s["end"], acc["pos"]).alias("pos"), F.concat(acc["out"], grown).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    rest = F.aggregate(
        found, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("text"), acc["pos"] + 1, F.length("text")))
    )
    clean = F.when(F.size(found) > 0, rest).otherwise(F.col("text"))
    return spans.withColumn("text", clean).select(*docs.columns)
