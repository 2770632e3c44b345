"""Personal data by candidate boosting: generators propose spans, boosted trees judge them, calibrated thresholds select.

DataFrame functions only: regular expressions, array functions, and the gradient-boosted trees of Spark ML.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, stored, text_of

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
#: The given formats, written so that a run of characters is tried from its start only and never
#: given back (the matches are the same; a long run costs its length, not its square).
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: High recall: the same kinds with other separators, spelled-out signs, or without what marks them.
LOOSE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}{{1,64}}+\x20?(?:@|[\[({{]\x20?(?:at|AT|@)\x20?[\])}}])\x20?[A-Za-z0-9-]{{1,63}}(?:\x20?(?:\.|[\[({{]\x20?(?:dot|DOT|\.)\x20?[\])}}])\x20?[A-Za-z0-9-]{{1,63}}){{1,8}}",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:[.,:_\x20-][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z])[+(]{0,2}[0-9](?:[\x20()./-]{0,3}[0-9]){6,14}(?![0-9])",
}
#: Only such texts are searched.
TELLING = r"[0-9@]|[\[({]\x20?(?:at|AT)\x20?[\])}]"
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
BEFORE = 24  # characters of context on the left of a candidate
FEATURES = ("kind", "length", "digits", "letters", "dots", "blanks", "dashes", "brackets", "groups", "plus", "at", "first_group", "last_group", "edge", "context")
CONTEXT = r"(?i)(mail|contact|write|call|phone|tel|fax|mobile|card|visa|credit|pay|ip|host|server|address|from|login)\W{0,12}$"
PRECISION = 0.98


def spans(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>, in code points, end exclusive.

    The text split at the pattern gives what lies between the matches, so places are running sums of lengths.
    """
    between, values = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start:int,end:int,value:string>>))")

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["value"])
        one = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"))
        return F.struct(end.alias("at"), F.concat(done["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(between, 1, F.size(values)), values, lambda g, v: F.struct(g.alias("gap"), v.alias("value")))
    return F.when(text.rlike(pattern), F.aggregate(pairs, none, step, lambda done: done["out"])).otherwise(F.expr("cast(array() as array<struct<start:int,end:int,value:string>>)"))


def _count(value: Column, keep: str) -> Column:
    return F.char_length(F.regexp_replace(value, f"[^{keep}]", ""))


def luhn(digits: Column) -> Column:
    """Whether the checksum holds: from the right, every second digit is doubled and its own digits are added."""
    def worth(i: Column) -> Column:
        d = F.substr(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(F.transform(F.sequence(F.lit(0), F.char_length(digits) - 1), worth), F.lit(0), lambda a, b: a + b) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """The test that a match of the base pattern has to pass."""
    if kind == "ip":
        return value.rlike(rf"^{_PART}(\.{_PART}){{3}}$")
    if kind == "card":
        digits = F.regexp_replace(value, "[^0-9]", "")
        return F.when(F.char_length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return _count(value, "0-9").between(9, 15)
    return F.lit(True)


def _of_kinds(text: Column, patterns: dict[str, str], tested: bool) -> Column:
    """All spans of all kinds, by start, then kind."""
    def of(k: int, kind: str) -> Column:
        found = spans(text, patterns[kind])
        if tested:
            found = F.filter(found, lambda x: holds(kind, x["value"]))
        return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(k).alias("kind"), x["end"].alias("end"), x["value"].alias("value")))

    return F.sort_array(F.concat(*(of(k, kind) for k, kind in enumerate(KINDS))))


def candidates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, base, loose): both span lists of every text; a loose one has the text before it and whether it is a base span."""
    text = text_of(text_col)
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int,value:string>>)")
    telling = text.rlike(TELLING)
    found = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("row"), text.alias("text"),
                        F.when(telling, _of_kinds(text, BASE, True)).otherwise(none).alias("base"),
                        F.when(telling, _of_kinds(text, LOOSE, False)).otherwise(none).alias("loose"))
    with_context = F.transform("loose", lambda x: F.struct(
        x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"), x["value"].alias("value"),
        F.substr("text", F.greatest(x["start"] - BEFORE, F.lit(0)) + 1, F.least(x["start"], F.lit(BEFORE))).alias("before"),
        F.exists("base", lambda b: (b["kind"] == x["kind"]) & (b["start"] == x["start"]) & (b["end"] == x["end"])).alias("is_base"),
        F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])).alias("over_base")))
    return found.select("id", "row", "base", with_context.alias("loose"))


def features(rows: DataFrame) -> DataFrame:
    """Format and context figures of candidates (``kind``, ``value``, ``before``). The tests of the base kinds are not among them."""
    v, before = F.col("value"), F.col("before")
    digits_first = F.char_length(F.regexp_extract(v, "[0-9]+", 0))
    digits_last = F.char_length(F.regexp_extract(v, "([0-9]+)[^0-9]*$", 1))
    known = {"kind": F.col("kind"), "length": F.char_length(v), "digits": _count(v, "0-9"), "letters": _count(v, "A-Za-z"), "dots": _count(v, "."), "blanks": _count(v, r"\x20"),
             "dashes": _count(v, "_/-"), "brackets": _count(v, "()\\[\\]{}"), "groups": F.size(F.regexp_extract_all(v, F.lit("[0-9]+"), F.lit(0))), "plus": v.startswith("+").cast("int"),
             "at": v.contains("@").cast("int"), "first_group": digits_first, "last_group": digits_last,
             "edge": F.when(before == "", 0).when(before.rlike(r"\s$"), 1).when(before.rlike("[A-Za-z]$"), 2).otherwise(3), "context": before.rlike(CONTEXT).cast("int")}
    return rows.withColumns({f"f_{n}": known[n].cast("double") for n in FEATURES})


def vectors(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(features(rows))


_OPEN, _CLOSE = r"\x20?[\[({]\x20?", r"\x20?[\])}]\x20?"
SAYS_IP = r"(?i)(ip|host|server|address|from|login)\W{0,12}$"
SAYS_PHONE = r"(?i)(call|phone|tel|fax|mobile)\W{0,12}$"


def possible(kind: str, value: Column) -> Column:
    """The test of the kind on a candidate's plain form: spelled-out signs as signs, other separators as the given ones."""
    if kind == "email":
        plain = F.regexp_replace(F.regexp_replace(value, f"{_OPEN}(?:at|AT|@){_CLOSE}", "@"), rf"{_OPEN}(?:dot|DOT|\.){_CLOSE}", ".")
        return plain.rlike(rf"^{_LOCAL}+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{{2,}}$")
    if kind == "ip":
        return value.rlike(r"^[0-9]+([.,:_\x20-])[0-9]+\1[0-9]+\1[0-9]+$") & holds("ip", F.regexp_replace(value, r"[,:_\x20-]", "."))
    return holds(kind, value)


def likely(kind: str, value: Column, before: Column) -> Column:
    """The weak label of a candidate: the test holds, and where numbers of any sort pass it, a sign or the text before speaks for the kind."""
    if kind == "ip":
        return possible(kind, value) & (value.contains(".") | before.rlike(SAYS_IP))
    if kind == "phone":
        return possible(kind, value) & (value.rlike(r"^(\+|00)") | before.rlike(SAYS_PHONE))
    return possible(kind, value)


def _by_kind(of) -> Column:
    return F.coalesce(*(F.when(F.col("kind") == k, of(kind)) for k, kind in enumerate(KINDS)), F.lit(False))


def altered(base: DataFrame) -> DataFrame:
    """Base spans written in a loose form, one of three by hash: they teach that separators do not decide."""
    v, way = F.col("value"), F.pmod(F.xxhash64("_h"), F.lit(3))
    choose = lambda *values: F.element_at(F.array(*values), way.cast("int") + 1)
    digits = F.regexp_replace(v, "[^0-9]", "")
    fours = lambda sign: F.regexp_replace(digits, r"([0-9]{4})(?=[0-9])", f"$1{sign}")
    dot_spelled = lambda x: F.regexp_replace(x, r"\.(?=[A-Za-z0-9-]+$)", " [dot] ")
    forms = (choose(F.regexp_replace(v, "@", " [at] "), F.regexp_replace(v, "@", " (at) "), dot_spelled(F.regexp_replace(v, "@", " [at] "))),
             choose(*(F.regexp_replace(v, r"\.", sign) for sign in ("-", "_", ":"))),
             choose(*map(fours, (".", "_", "/"))),
             choose(F.concat(F.lit("00"), F.substr(v, F.lit(2))), F.substr(v, F.lit(2)), F.regexp_replace(F.substr(v, F.lit(2)), r"[\x20()-]+", ".")))
    return base.withColumn("value", F.coalesce(*(F.when(F.col("kind") == k, form) for k, form in enumerate(forms))))


@dataclass
class Selector:
    """Boosted trees and the score from which each kind is selected; without trees nothing is."""

    trees: GBTClassificationModel | None = None
    least: dict[int, float] = field(default_factory=dict)


def taught_rows(loose: DataFrame) -> DataFrame:
    """(kind, f_*, label, held, n): how often each row of features occurs among all candidates, base spans counted once more in a loose form.

    The label is :func:`likely`, which holds for base spans: not whether the given format matches, so a candidate in another form can
    be taught as a span. Every fourth candidate, by hash, is held out.
    """
    real = loose.withColumn("_h", F.xxhash64("id", "row", "start", "kind", "value")).select("kind", "value", "before", "is_base", "_h")
    label = F.col("is_base") | _by_kind(lambda kind: likely(kind, F.col("value"), F.col("before")))
    both = real.withColumn("label", label).unionByName(altered(real.filter("is_base")).withColumn("label", F.lit(True)))
    rows = features(both).withColumns({"label": F.col("label").cast("double"), "held": F.pmod("_h", F.lit(4)) == 0})
    return rows.groupBy("kind", *(f"f_{n}" for n in FEATURES), "label", "held").agg(F.count(F.lit(1)).alias("n"))


def learn(loose: DataFrame, precision: float = PRECISION, seed: int = 17) -> Selector:
    """Trees that tell likely spans from other candidates by format and context, and thresholds calibrated on the fourth held out.

    All candidates count: equal rows of features are one row with their number as weight, so what the trees go over grows with the
    different rows. (Beyond 10,000 of these Spark ML proposes split points from a part; the splits are chosen on all.) A kind's threshold is
    the least score from which the share of likely spans, one failure added, reaches ``precision``; a kind without calibration rows is not
    added. Without both classes nothing is learned.
    """
    counted = stored(taught_rows(loose), "candidate-counts")
    assembled = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="features").transform(counted)
    taught = assembled.filter("not held")
    if taught.select("label").distinct().count() < 2:
        return Selector()
    trees = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=seed, maxBins=32, weightCol="n").fit(taught)
    scored = trees.transform(assembled.filter("held")).select("kind", "label", "n", F.floor(vector_to_array("probability")[1] * 100).alias("bin"))
    table = (scored.groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("all"))
             .orderBy("kind", F.desc("bin")).collect())  # at most 4 x 101 rows
    least: dict[int, float] = {}
    for kind in {r.kind for r in table}:
        good = every = 0
        for r in (r for r in table if r.kind == kind):
            good, every = good + r.good, every + r["all"]
            if good / (every + 1) >= precision:
                least[kind] = r.bin / 100
    return Selector(trees, least)


def select(loose: DataFrame, model: Selector) -> DataFrame:
    """(id, row, added): candidates that overlap no base span, are ``possible`` and score at least their kind's threshold; of overlapping ones the first."""
    open_ones = loose.filter("not over_base").filter(_by_kind(lambda kind: possible(kind, F.col("value"))))
    if model.trees is None or not model.least:
        open_ones = open_ones.filter("false").withColumn("score", F.lit(0.0))
    else:
        least = F.coalesce(*(F.when(F.col("kind") == k, F.lit(x)) for k, x in sorted(model.least.items())), F.lit(2.0))
        open_ones = model.trees.transform(vectors(open_ones)).withColumn("score", vector_to_array("probability")[1]).filter(F.col("score") >= least)
    grouped = open_ones.groupBy("id", "row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("found"))
    none = F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")
    first = F.aggregate("found", none, lambda done, x: F.when((F.size(done) > 0) & (x["start"] < F.element_at(done, -1)["end"]), done).otherwise(F.concat(done, F.array(x))))
    return grouped.select("id", "row", first.alias("added"))


def count_of(found: Column, kind: str) -> Column:
    k = KINDS.index(kind)
    return F.size(F.filter(found, lambda x: x["kind"] == k)).cast("long")


def joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: the given formats, and all spans with those that the trees add.

    Both are arrays of struct<start, kind, end> by start, then kind (its number in KINDS), in code points.

    Defined cases: a null or empty text has no spans; rows that repeat are searched each; texts are searched whole;
    an empty table gives an empty one and teaches nothing; other columns are not read.

    Scale: texts are searched where they lie and never shuffled; a text without a digit or an at sign is passed over.
    What is stored is the spans and the counts of equal candidates; what is joined back is the few that are added.
    """
    found = stored(candidates(docs, id_col, text_col), "personal-spans")
    loose = found.filter(F.size("loose") > 0).select("id", "row", F.explode("loose").alias("x")).select("id", "row", "x.*")
    added = select(loose, learn(loose))
    f, a = found.alias("f"), added.alias("a")
    both = f.join(a, F.col("f.id").eqNullSafe(F.col("a.id")) & (F.col("f.row") == F.col("a.row")), "left")
    plain = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    out = both.select(F.col("f.id").alias(id_col), plain.alias("base"), "added")
    return out.select(id_col, "base", F.when(F.col("added").isNull(), F.col("base")).otherwise(F.sort_array(F.concat("base", "added"))).alias("spans"))
