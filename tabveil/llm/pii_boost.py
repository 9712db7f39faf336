"""Personal data: candidates from wide generators, judged by boosted trees.

Fixed base patterns give spans that always stand. Wider generators propose
further, overlapping spans: looser forms of the base kinds, secrets and bank
numbers. A proposal is a candidate where it touches no base span. Its label is
evidence that its features do not see and the base does not use: check digits of
loose card and bank numbers, octet ranges, top-level names, cue words before a
telephone number or a secret. Gradient boosted trees learn from format and context
which candidates have that evidence, so that those without it are found too. Each
kind has its own threshold: the least score that keeps the wanted precision on
candidates held back from the fit. A kind with too few of them adds nothing. Of
overlapping candidates the best stays.

Everything on rows is SQL expressions: the trees become CASE expressions over a
document's array of candidates, so no row is shuffled. Overlaps are looked up
behind fences, runs of FENCE sorted spans. The fit and the thresholds take the candidates
of all documents, half each by a hash of id and text; equal candidates are
counted and weigh as much.

Positions are code points, ends exclusive. Null and empty texts have no spans.
Very long texts are judged whole. Ties go to the earlier start, then the earlier
kind. Rows with null or repeated ids are judged each, extra columns are ignored, an
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabveil.session import materialize

TREES, DEPTH = 15, 3
PRECISION = 0.95
MIN_SUPPORT = 20
AROUND = 24
CHUNK = 256
FENCE = 64

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret", "iban")

# The base patterns. Possessive repeats and run starts change no match,
# they only keep Java's matcher from recursing or trying every start of a long run.
# A card match is a whole run of digits, so its length can be part of the pattern.
RUN_START = r"(?:\G|(?<![A-Za-z0-9._%+-]))"
DIGIT_START = r"(?:\G|(?<![0-9]))"
BASE = {
    "email": RUN_START + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": DIGIT_START + r"[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap condition that every text with a match meets.
GATE = {
    "email": "contains(body, '@')",
    "ip": r"body RLIKE '[0-9]\\.[0-9]'",
    "card": r"body RLIKE '[0-9][\\x20-]?[0-9]'",
    "phone": "contains(body, '+')",
}
# Of a part that has digits: none may be left behind its zeros.
OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
WIDE = {
    "email": RUN_START + r"[A-Za-z0-9._%+-]++(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]++)++",
    "ip": DIGIT_START + r"[0-9]{1,4}(?:\x20?\.\x20?[0-9]{1,4}){3}(?![0-9])",
    "card": DIGIT_START + r"[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00|\()?[0-9][\x20()./0-9-]{5,24}[0-9](?![0-9])",
    "secret": r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+={0,2}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,4})?(?![A-Za-z0-9])",
}
WIDE_GATE = GATE | {"email": "contains(body, '@') OR contains(lower(body), 'at)') OR contains(lower(body), 'at]')",
                    "phone": r"body RLIKE '[0-9][\\x20()./0-9-]{5}'", "ip": r"body RLIKE '[0-9]\\x20?\\.\\x20?[0-9]'",
                    "secret": "body RLIKE '[A-Za-z0-9_+/-]{16}'", "iban": "body RLIKE '[A-Z]{2}[0-9]{2}'"}
# Words that tell a kind when they stand before a candidate. Those of telephone numbers and secrets are evidence, not features.
CUES = {"email": "mail|contact|write", "ip": "ip|host|server|address", "card": "card|visa|credit|pay", "iban": "iban|bank|account"}
PHONE_CUE = r"(?:tel|phone|call|mobile|fax)[a-z]*+[\x20.:]*+$"
SECRET_CUE = r"(?:token|secret|passwo?r?d|api[_-]?key|access[_-]?key|bearer|credential)s?[\x22\x27]?\x20*+[:=]?\x20*+[\x22\x27]?$"
TOP_LEVEL = r"(?:\.|dot[\])]\x20?)(?:com|org|net|edu|gov|info|[a-z]{2})$"

FEATURES = ["kind_no", "n_chars", "n_digits", "n_dots", "n_spaces", "n_dashes", "n_other", "n_groups", "longest_group", "cue_before",
            "glued_before", "glued_after", "upper_share", "n_switches"]


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def located(pattern: str, gate: str) -> str:
    """SQL for all matches of a pattern in ``body``: array of (start, stop, found).

    Positions are running sums of lengths. They are taken first over chunks of
    matches and then within each, so a text with n matches costs n * CHUNK steps.
    """
    p = quoted(pattern)
    spans = "array<struct<start:int,stop:int,found:string>>"
    matches = (f"filter(zip_with(split(body, {p}, -1), regexp_extract_all(body, {p}, 0), (g, f) -> struct(g AS gap, f AS found)), "
               "m -> m.found IS NOT NULL)")
    chunks = f"transform(sequence(1, greatest(1, size(p)), {CHUNK}), i -> slice(p, i, {CHUNK}))"
    offsets = ("aggregate(cs, struct(0 AS at, CAST(array() AS array<int>) AS seen), (s, c) -> struct("
               "aggregate(c, s.at, (t, m) -> t + length(m.gap) + length(m.found)) AS at, concat(s.seen, array(s.at)) AS seen), s -> s.seen)")
    walk = (f"aggregate(c, struct(o AS at, CAST(array() AS {spans}) AS spans), "
            "(s, m) -> struct(s.at + length(m.gap) + length(m.found) AS at, concat(s.spans, array(struct("
            "s.at + length(m.gap) AS start, s.at + length(m.gap) + length(m.found) AS stop, m.found AS found))) AS spans), s -> s.spans)")
    # One-element arrays give names to what is used twice.
    named = (f"flatten(flatten(transform(array({matches}), p -> flatten(transform(array({chunks}), "
             f"cs -> zip_with(cs, {offsets}, (c, o) -> {walk}))))))")
    return f"CASE WHEN {gate} THEN {named} ELSE CAST(array() AS {spans}) END"


def luhn(digits: str) -> str:
    """SQL: does a text of digits pass the Luhn check?"""
    return (f"aggregate(transform(sequence(1, length({digits})), i -> CAST(substring({digits}, -i, 1) AS int) * (2 - i % 2)), 0, "
            "(s, d) -> s + CASE WHEN d > 9 THEN d - 9 ELSE d END) % 10 = 0")


def valid(kind: str) -> str:
    """SQL: does a base match ``m`` pass its check?"""
    digits = "regexp_replace(m.found, '[^0-9]', '')"
    return {
        "email": "true",
        "ip": f"m.found RLIKE {quoted(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn(digits)}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
    }[kind]


def base_spans() -> str:
    """SQL: all base spans of ``body`` by kind, then start: array of (kind, start, stop)."""
    per_kind = [f"transform(filter({located(BASE[k], GATE[k])}, m -> {valid(k)}), m -> struct({i} AS kind, m.start AS start, m.stop AS stop))"
                for i, k in enumerate(KINDS)]
    return f"concat({', '.join(per_kind)})"


def before() -> str:
    """SQL: the text before a match ``m``."""
    return f"lower(substring(body, greatest(1, m.start + 1 - {AROUND}), least(m.start, {AROUND})))"


def evidence(kind: str) -> str:
    """SQL: what speaks for a match ``m`` besides its features."""
    digits = "regexp_replace(m.found, '[^0-9]', '')"
    plain = "regexp_replace(m.found, '\\\\x20', '')"
    # A letter counts as two digits, A as 10; the first four characters go to the end.
    remainder = (f"aggregate(split(concat(substring({plain}, 5), substring({plain}, 1, 4)), ''), 0, (s, x) -> CASE WHEN x = '' THEN s "
                 "WHEN x <= '9' THEN (s * 10 + CAST(x AS int)) % 97 ELSE (s * 100 + ascii(x) - 55) % 97 END)")
    return {
        "email": f"lower(m.found) RLIKE {quoted(TOP_LEVEL)}",
        "ip": f"{plain} RLIKE {quoted(f'^{OCTET}(?:[.]{OCTET}){{3}}$')}",
        "card": luhn(digits),
        "phone": f"{before()} RLIKE {quoted(PHONE_CUE)}",
        "secret": f"{before()} RLIKE {quoted(SECRET_CUE)}",
        "iban": f"{remainder} = 1",
    }[kind]


def candidates(labelled: bool = False) -> str:
    """SQL: proposed spans of ``body`` with features, and the label where asked: array of structs."""
    per_kind = []
    for i, k in enumerate(ALL_KINDS):
        count = lambda p: f"CAST(regexp_count(m.found, {quoted(p)}) AS double)"
        after = "substring(body, m.stop + 1, 1)"
        groups = "filter(split(m.found, '[^0-9]+'), g -> g <> '')"
        fields = {
            "kind_no": f"CAST({i} AS double)", "n_chars": "CAST(length(m.found) AS double)", "n_digits": count("[0-9]"), "n_dots": count(r"\."),
            "n_spaces": count(r"\x20"), "n_dashes": count("-"), "n_other": count(r"[^0-9A-Za-z.\x20-]"), "n_groups": f"CAST(size({groups}) AS double)",
            "longest_group": f"CAST(coalesce(array_max(transform({groups}, g -> length(g))), 0) AS double)",
            "cue_before": f"CAST({before()} RLIKE '{CUES[k]}' AS double)" if k in CUES else "CAST(0 AS double)",
            "glued_before": f"CAST({before()} RLIKE '[a-z0-9_]$' AS double)", "glued_after": f"CAST({after} RLIKE '[A-Za-z0-9_]' AS double)",
            "upper_share": f"{count('[A-Z]')} / length(m.found)", "n_switches": count("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        }
        if labelled:
            fields["label"] = f"CAST({evidence(k)} AS double)"
        features = ", ".join(f"{sql} AS {name}" for name, sql in fields.items())
        per_kind.append(f"transform({located(WIDE[k], WIDE_GATE[k])}, m -> struct({i} AS kind, m.start AS start, m.stop AS stop, {features}))")
    return f"concat({', '.join(per_kind)})"


def apart(spans: str, others: str, unless: str = "true") -> str:
    """SQL: those of ``spans`` (c) that overlap none of ``others`` (b) for which ``unless`` holds.

    The others are sorted and fenced, so a span looks at the borders of the
    fences and into few of them.
    """
    fenced = (f"transform(sequence(1, size(o), {FENCE}), i -> struct(slice(o, i, {FENCE}) AS own, element_at(o, i).start AS low, "
              f"array_max(transform(slice(o, i, {FENCE}), x -> x.stop)) AS high))")
    kept = ("filter({spans}, c -> NOT exists(fs, f -> f.low < c.stop AND c.start < f.high AND exists(f.own, "
            "b -> b.start < c.stop AND c.start < b.stop AND ({unless}))))").format(spans=spans, unless=unless)
    # One-element arrays give names to what is used twice.
    return (f"CASE WHEN size({others}) = 0 OR size({spans}) = 0 THEN {spans} ELSE "
            f"flatten(transform(array({others}), o -> flatten(transform(array({fenced}), fs -> {kept})))) END")


@dataclass(frozen=True)
class Judge:
    """Trees as one SQL expression over a candidate ``c``, and the threshold of each kind that adds spans."""

    sql: str | None
    thresholds: dict[int, float]


def double(value: float) -> str:
    """SQL: a double, which a plain literal with a point is not."""
    return f"{float(value)!r}D"


def _tree_sql(node) -> str:
    if node.numDescendants() == 0:
        return double(node.prediction())
    split = node.split()
    return (f"CASE WHEN c.{FEATURES[split.featureIndex()]} <= {double(split.threshold())} THEN {_tree_sql(node.leftChild())} "
            f"ELSE {_tree_sql(node.rightChild())} END")


def smallest(places: DataFrame, n: int) -> Column:
    """The condition that ``place`` is among the about ``n`` smallest, never more: cut by counting leading bits, 16 at a time."""
    prefix, bits, room = 0, 16, n
    while True:
        lead = F.shiftrightunsigned(F.col("place"), 64 - bits)
        inside = places if bits == 16 else places.where(F.shiftrightunsigned(F.col("place"), 80 - bits) == prefix >> 16)
        counts = {r["lead"]: r["n"] for r in inside.groupBy(lead.alias("lead")).agg(F.count(F.lit(1)).alias("n")).collect()}
        cut = prefix
        for value in sorted(counts):
            if counts[value] > room:
                # Most rows are in: only where next to nothing is, the slice is cut finer.
                if room < n // 2 or bits == 48:
                    return F.shiftrightunsigned(F.col("place"), 64 - bits) < value
                prefix, bits = value << 16, bits + 16
                break
            room -= counts[value]
            cut = value + 1
        else:
            return F.shiftrightunsigned(F.col("place"), 64 - bits) < cut


def fit(documents: DataFrame, precision: float = PRECISION, trees: int = TREES, depth: int = DEPTH) -> Judge:
    """Fit and calibrate on the candidates of all documents (id, body)."""
    placed = documents.where(F.expr("body RLIKE '[0-9]|[A-Za-z0-9_+/-]{16}'")).select("body", F.xxhash64("id", "body").alias("place"))
    found = placed.withColumn("base", F.expr(sorted_spans(base_spans())))
    found = found.withColumn("proposed", F.expr(candidates(labelled=True))).withColumn("free", F.expr(apart("proposed", "base")))
    found = found.select(F.pmod("place", F.lit(2)).alias("half"), F.explode_outer("free").alias("c")).where("c IS NOT NULL")
    alike = found.select("half", "c.kind", *[f"c.{f}" for f in FEATURES], "c.label").groupBy("half", "kind", *FEATURES, "label")
    rows = materialize(alike.agg(F.count(F.lit(1)).cast("double").alias("weight")), "candidates")
    seen = {(r["half"], r["label"]) for r in rows.groupBy("half", "label").count().collect()}
    if not {(0, 0.0), (0, 1.0), (1, 1.0)} <= seen:
        return Judge(None, {})
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows.where("half = 0"))
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, seed=1, stepSize=0.3).fit(vectors)
    weights = list(model.treeWeights)
    sql = " + ".join(f"{double(w)} * ({_tree_sql(t._java_obj.rootNode())})" for w, t in zip(weights, model.trees))
    held = rows.where("half = 1").select("kind", F.struct(*FEATURES).alias("c"), "label", "weight").withColumn("score", F.expr(sql))
    # At most as many groups as the trees have distinct sums.
    down = Window.partitionBy("kind").orderBy(F.desc("score"))
    steps = held.groupBy("kind", "score").agg(F.sum(F.col("label") * F.col("weight")).alias("good"), F.sum("weight").alias("n"))
    steps = steps.withColumns({"good": F.sum("good").over(down), "n": F.sum("n").over(down)})
    least = steps.where((F.col("good") >= precision * F.col("n")) & (F.col("n") >= MIN_SUPPORT)).groupBy("kind").agg(F.min("score").alias("least"))
    return Judge(sql, {r["kind"]: r["least"] for r in least.collect()})


def sorted_spans(spans: str) -> str:
    """SQL: (start, stop, kind) of spans, by start."""
    return f"array_sort(transform({spans}, s -> struct(s.start AS start, s.stop AS stop, s.kind AS kind)))"


def with_spans(documents: DataFrame, judge: Judge) -> DataFrame:
    """Documents with ``base`` and ``added``: arrays of (start, stop, kind), by start."""
    based = documents.withColumn("base", F.expr(sorted_spans(base_spans())))
    if not judge.thresholds:
        return based.withColumn("added", F.expr("CAST(array() AS array<struct<start:int,stop:int,kind:int>>)"))
    least = " ".join(f"WHEN {k} THEN {double(v)}" for k, v in sorted(judge.thresholds.items()))
    scored = (f"array_sort(filter(transform(free, c -> struct(c.start AS start, c.stop AS stop, c.kind AS kind, {judge.sql} AS score)), "
              f"x -> x.score >= CASE x.kind {least} END))")
    better = "b.score > c.score OR b.score = c.score AND (b.start < c.start OR b.start = c.start AND b.kind < c.kind)"
    proposed = f"filter({candidates()}, c -> c.kind IN ({', '.join(map(str, sorted(judge.thresholds)))}))"
    return based.withColumn("proposed", F.expr(proposed)).withColumn("free", F.expr(apart("proposed", "base"))).withColumn(
        "judged", F.expr(scored)).withColumn("added", F.expr(sorted_spans(apart("judged", "judged", better)))).drop("proposed", "free", "judged")


def listed(spans: str) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = "array(" + ", ".join(f"'{k}'" for k in ALL_KINDS) + ")"
    by_kind = f"array_sort(transform({spans}, s -> struct(s.kind AS kind, s.start AS start, s.stop AS stop)))"
    return F.expr(f"array_join(transform({by_kind}, s -> concat_ws(':', element_at({names}, s.kind + 1), s.start, s.stop)), ',')")


def find(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Id, text, base spans and added spans of every document."""
    docs = documents.select(F.col(id_column).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    return with_spans(docs, fit(docs)).withColumnsRenamed({"id": id_column, "body": text})


def redact(documents: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in angle brackets; a null text stays null."""
    docs = documents.select(F.col(f"`{id_column}`").alias("id"), F.col(f"`{text}`").alias("raw"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"),
                            *[F.col(f"`{c}`").alias(f"own_{i}") for i, c in enumerate(documents.columns)])
    found = with_spans(docs, fit(docs.select("id", "body")))
    marks = "array(" + ", ".join(f"'<{k.upper()}>'" for k in ALL_KINDS) + ")"
    ordered = sorted_spans("concat(base, added)")
    # A span that begins inside the one before only moves the end.
    built = (f"aggregate({ordered}, struct(0 AS at, '' AS done), (a, s) -> struct(greatest(a.at, s.stop) AS at, CASE WHEN s.start >= a.at THEN "
             f"concat(a.done, substring(body, a.at + 1, s.start - a.at), element_at({marks}, s.kind + 1)) ELSE a.done END AS done), "
             "a -> concat(a.done, substring(body, a.at + 1)))")
    clean = F.expr(f"CASE WHEN raw IS NULL OR size(base) + size(added) = 0 THEN raw ELSE {built} END")
    at = documents.columns.index(text)
    return found.select(*[(clean if i == at else F.col(f"own_{i}")).alias(c) for i, c in enumerate(documents.columns)])
