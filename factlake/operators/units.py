"""Problem 5: quantities recorded in different units and scales.

A value states its unit itself, or the snippet around it does, as an annotation of a label ("(₹ in Cr)",
", in thousands of rupees", "Figures in lakh"). These readings are the candidates of a row. All observations of one
quantity (same document and fact type, from both fact tables) obey the identity that they are the same
magnitude; the median logarithm of the others, the row's own fact left out, is the reference. Where a row has
several candidates (a snippet names several units, or an unknown word stands behind the number) the one
with the least log residual is chosen, if it is unique: the next one must be clearly worse. A row with one reading is in that
unit, whatever the numbers say; where nothing is named the common unit holds. For every row the residuals of all units
show whether the numbers bear that out, and the solution is flagged as non-unique where they do not tell.

Defined results: null, blank and "--" values have no number and no result; zero loads convert to zero and are no
case; fact types without a common unit are left out; rows delivered twice give one row; an empty table gives none.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factlake.common import spread, written

# Unit, dimension, factor to the dimension's base (rupees, percent), spellings.
UNITS = (
    ("crore", "money", 1e7, ("crores", "crore", "cr", "करोड़")),
    ("billion", "money", 1e9, ("billion", "bn")),
    ("million", "money", 1e6, ("million", "mio", "mn")),
    ("lakh", "money", 1e5, ("lakhs", "lakh", "lacs", "lac", "l", "लाख")),
    ("thousand", "money", 1e3, ("thousands", "thousand", "tsd", "k", "'000", "’000", "हज़ार")),
    ("paise", "money", 0.01, ("paise", "paisa", "p", "पैसे")),
    ("rupees", "money", 1.0, ("rupees", "rupee", "rs", "inr", "₹", "रुपये", "/-")),
    ("basis point", "rate", 0.01, ("basis points", "basis point", "basispunkte", "bps", "bp")),
    ("per mille", "rate", 0.1, ("per mille", "permille", "‰")),
    ("percent", "rate", 1.0, ("percent", "per cent", "pct", "%", "प्रतिशत")),
    ("fraction", "rate", 100.0, ("share of 1", "fraction of assets", "fraction of 1")),
)
FACTOR = {name: factor for name, _, factor, _ in UNITS}
# Encodings in which UTF-8 text of the snippets may have been misread.
MISREAD = ("cp1252", "latin-1", "cp1251", "mac_roman", "cp437")
CLEAR = 0.9  # the next unit's residual must be larger by this much for a unique solution
STEP = 0.01  # observations are counted in steps of this width of their logarithm


def _misread(word: str) -> list[str]:
    """How a word of the snippet looks after one or two wrong decodings."""
    out = []
    for codec in MISREAD:
        once = "".join(_byte(b, codec) for b in word.encode())
        out += [once, "".join(_byte(b, codec) for b in once.encode())]
    try:
        out.append(word.encode().decode("gb18030"))
    except UnicodeDecodeError:
        pass
    return out


def _byte(b: int, codec: str) -> str:
    try:
        return bytes([b]).decode(codec)
    except UnicodeDecodeError:
        return chr(b)


@lru_cache(maxsize=None)
def _spelled(dimension: str) -> tuple[str, dict[str, str]]:
    """(alternation of a dimension's spellings, longest first; small spelling -> unit), with other normal forms and misread forms of those that are not ASCII."""
    unit_of: dict[str, str] = {}
    for name, d, _, words in UNITS:
        if d != dimension:
            continue
        for w in words:
            for form in (w, unicodedata.normalize("NFC", w), unicodedata.normalize("NFD", w)):
                for x in [form] if form.isascii() else [form, *_misread(form)]:
                    unit_of.setdefault(x.lower(), name)
    border = r"(?![\p{L}\p{M}])"
    return "|".join(re.escape(w) + (border if w[-1].isalpha() else "") for w in sorted(unit_of, key=lambda w: (-len(w), w))), unit_of


def _unit(spelling: Column, dimension: str) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(_spelled(dimension)[1].items()) for x in kv]), F.lower(spelling))


def _first(text: Column, dimension: str, before: str) -> Column:
    """The unit whose spelling follows the pattern first in the text; null if there is none."""
    return _unit(F.regexp_extract(text, f"(?iu){before}({_spelled(dimension)[0]})", 1), dimension)


def _every(text: Column, dimension: str, before: str, after: str) -> Column:
    """All units whose spelling stands in the text between the two patterns, in their order."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"(?iu){before}({_spelled(dimension)[0]}){after}"), F.lit(1)), lambda x: _unit(x, dimension))


def _number_token(value: Column) -> Column:
    ascii_ = F.translate(value, "०१२३४५६७८९٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    return F.nullif(F.regexp_extract(ascii_, r"(\d(?:[\d.,'’   ]*\d)?)", 1), F.lit(""))


def number(value: Column) -> Column:
    """The first number of a text: Indian, western and continental grouping, Latin or Indic or Arabic digits."""
    t = F.regexp_replace(_number_token(value), "['’   ]", "")
    continental = t.rlike(r"^\d{1,3}(\.\d{3})+,\d+$") | t.rlike(r"^\d+,\d{1,2}$") & ~t.rlike(r"^\d+,\d{2},")
    plain = F.when(continental, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def _tail(value: Column) -> Column:
    """What follows the first number, up to the next one."""
    ascii_ = F.translate(value, "०१२३४५६७८९٠١٢٣٤٥٦٧٨٩", "01234567890123456789")
    return F.regexp_extract(ascii_, r"\d(?:[\d.,'’   ]*\d)?([^\d]*(?:'000|’000)?)", 1)


def unit_of_value(value: Column, money: Column) -> Column:
    """The unit that a value states: behind its number, else a currency sign before it; null if it states none."""
    tail, head = _tail(value), F.regexp_extract(value, r"^([^\d]*)", 1)
    behind = r"^[\s\u00a0]*"
    return F.when(money, F.coalesce(_first(tail, "money", behind), F.when(_first(head, "money", r"(?<![\p{L}])").isNotNull(), F.lit("rupees")))).otherwise(_first(tail, "rate", behind))


def unknown_word(value: Column) -> Column:
    """Whether a word or sign of no known unit stands right behind the number of a value."""
    return _tail(value).rlike(r"^[\s\u00a0]*[\p{L}\p{Sc}%‰/']")


def units_of_snippet(snippet: Column, money: Column) -> Column:
    """The different units that a snippet gives for its number: in brackets, behind a comma or dash of a label, in a line on all figures; in this order."""
    # one line of the snippet at a time: a bracket, a comma or dash, "in ...", "as a ..." or "Figures in ..."
    marks = r"\([^()\n]*?(?<![\p{L}\p{M}])", r"(?:, (?:in )?|[–—-] |\S{1,9} )(?:rs\.? |₹ ?)?(?<![\p{L}\p{M}])", r"(?m)^[^\n,(]*[\p{L}] (?:in|as an?) (?:rs\.? |₹ ?)?"
    ends = r"[.]?\)", r"[.]?(?: of rupees)?(?=[ ]*(?:$|\n|:|starts at|[^\x00-\x7F ]{1,9} \d))", r"[.]?(?: of rupees)?(?=[ ]*(?:$|\n|:|starts at|[^\x00-\x7F]))"
    labelled = F.array_join(F.filter(F.split(snippet, "\n"), _annotated), "\n")

    def named(dimension: str) -> Column:
        return F.array_distinct(F.filter(F.concat(*[_every(labelled, dimension, m, e) for m, e in zip(marks, ends)]), lambda u: u.isNotNull()))

    return F.when(snippet.isNull() | (labelled == ""), F.array().cast("array<string>")).when(money, named("money")).otherwise(named("rate"))


def _annotated(line: Column) -> Column:
    """Lines that may annotate: with a bracket, a comma, a dash before a currency, ' in ' or ' as a '."""
    return line.rlike(r"(?iu)\(|, |(?:–|—|-|[^\x00-\x7F]{2,9}) (?:rs|inr|₹)| in | as an? ") & ~line.rlike(r"^[^\p{L}]*\d[^\n]*$")


def readings(facts: DataFrame, common_units: DataFrame) -> DataFrame:
    """(fact_id, doc_id, fact_type, number, money, common, candidates, stated): one row per fact of the listed types with a number.

    candidates are the units that the row may be in: the one that the value states; else all that the snippet names; else, where an unknown
    word stands behind the number, all of the dimension; else the common unit. stated: value or snippet names a unit.
    """
    f = spread(facts).select("fact_id", "doc_id", "fact_type", "value", "raw_snippet")
    c = common_units.select("fact_type", F.lower("common_unit").alias("c")).dropDuplicates(["fact_type"])
    c = c.withColumn("money", F.col("c").contains("rupee")).withColumn("common", F.when(F.col("c").contains("crore"), "crore").when(F.col("money"), "rupees").otherwise("percent")).drop("c")
    t = f.join(c, "fact_type").withColumn("number", number("value")).where("number is not null")
    own, named = unit_of_value(F.col("value"), F.col("money")), units_of_snippet(F.col("raw_snippet"), F.col("money"))
    t = t.withColumn("own", own).withColumn("named", F.when(F.col("own").isNull(), named).otherwise(F.array("own")))
    open_ = F.when(unknown_word(F.col("value")), _all_units()).otherwise(F.array("common"))
    t = t.withColumn("stated", F.size("named") > 0).withColumn("candidates", F.when(F.col("stated"), F.col("named")).otherwise(open_))
    return t.select("fact_id", "doc_id", "fact_type", "number", "money", "common", "candidates", "stated").dropDuplicates()


def _all_units() -> Column:
    money, rate = ([n for n, d, _, _ in UNITS if d == k] for k in ("money", "rate"))
    return F.when(F.col("money"), F.array(*map(F.lit, money))).otherwise(F.array(*map(F.lit, rate)))


def _factor(unit: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in FACTOR.items() for x in kv]), unit)


def _magnitude(unit: Column) -> Column:
    return F.ln(F.col("number") * _factor(unit))


def reference(seen: DataFrame) -> DataFrame:
    """(doc_id, fact_type, n, all, low, high): lower median of a quantity's n observations x, and those of the n - 1 others of one above ``low`` (low) or not above it (high).

    Observations are counted in steps of STEP first, so a quantity has a bounded number of rows however often it was observed; a step stands for its mean.
    """
    bins = seen.groupBy("doc_id", "fact_type", F.floor(F.col("x") / STEP).alias("bin")).agg(F.count("*").alias("c"), F.avg("x").alias("x"))
    quantity = Window.partitionBy("doc_id", "fact_type")
    upto = bins.withColumn("upto", F.sum("c").over(quantity.orderBy("bin"))).withColumn("n", F.sum("c").over(quantity))
    at = lambda k: F.max(F.when((F.col("upto") >= k) & (F.col("upto") - F.col("c") < k), F.col("x")))
    half = F.expr("n div 2")
    return upto.groupBy("doc_id", "fact_type").agg(F.max("n").alias("n"), at(F.expr("(n + 1) div 2")).alias("all"), at(half).alias("low"), at(half + 1).alias("high"))


def decided(facts: DataFrame, earlier: DataFrame, common_units: DataFrame, only_doubtful: bool = False) -> DataFrame:
    """readings with centre, tried, unique, proposed and the unit that each row is in.

    The reference of a row is the median of the quantity's other observations whose unit is clear, in both fact tables. A row with one candidate is
    in that unit. Of several, the one with the least log residual is chosen where it is unique; else the first that the row names, or the common unit.
    only_doubtful leaves the comparison of rows with one candidate out.
    """
    r = written(readings(facts, common_units))
    clear = r.where("stated and size(candidates) = 1 and number > 0")
    x = _magnitude(F.col("candidates")[0])
    seen = clear.groupBy("doc_id", "fact_type", "fact_id").agg(F.avg(x).alias("x")).drop("fact_id")  # a fact is one observation
    old = readings(earlier.select(F.col("id").alias("fact_id"), "doc_id", "fact_type", "value", F.lit("").alias("raw_snippet")), common_units)
    old = old.where("number > 0 and size(candidates) = 1").select("doc_id", "fact_type", x.alias("x"))
    compared = r.where("size(candidates) > 1") if only_doubtful else r
    t = compared.join(reference(seen.unionByName(old)), ["doc_id", "fact_type"], "left")
    own = F.when(F.col("stated") & (F.size("candidates") == 1) & (F.col("number") > 0), x)
    others = F.when(F.floor(own / STEP) > F.floor(F.col("low") / STEP), F.col("low")).otherwise(F.col("high"))
    t = t.withColumn("centre", F.when(own.isNull(), F.col("all")).when(F.col("n") > 1, others))
    t = t.withColumn("tried", F.when((F.col("number") > 0) & F.col("centre").isNotNull(), _tried(_all_units()))).withColumn("fitting", F.when(F.col("tried").isNotNull(), _tried(F.col("candidates"))))
    one, named = F.size("candidates") == 1, F.col("candidates")[0]
    chosen = F.when(~one & _unique(F.col("fitting")), F.col("fitting")[0]["u"])
    t = t.withColumn("unit", F.coalesce(F.when(one, named), chosen, F.when(F.col("stated"), named), F.col("common")))
    cols = [*r.columns, "unit", "tried"]
    return t.select(cols).unionByName(r.where("size(candidates) = 1").withColumn("unit", named).withColumn("tried", F.lit(None).cast(t.schema["tried"].dataType)).select(cols)) if only_doubtful else t.select(cols)


def _tried(units: Column) -> Column:
    """Units with their log residuals, the least first; of equal ones the common unit."""
    return F.array_sort(F.transform(units, lambda u: F.struct(F.abs(_magnitude(u) - F.col("centre")).alias("r"), (u != F.col("common")).alias("other"), u.alias("u"))))


def _unique(tried: Column) -> Column:
    return F.coalesce(F.get(tried, F.lit(1))["r"] - F.get(tried, F.lit(0))["r"] >= CLEAR, F.lit(False))


def _converted() -> Column:
    return F.col("number") * _factor(F.col("unit")) / _factor(F.col("common"))


def convert(facts: DataFrame, earlier: DataFrame, common_units: DataFrame) -> DataFrame:
    """One row per fact with a number: value in the common unit, the unit it was in, and what the identities say.

    Columns: fact_id, fact_type, unit, common_unit, converted, stated, proposed, residual, unique, agrees. proposed is the unit of all with the
    least log residual against the quantity's other observations.
    """
    t = decided(facts, earlier, common_units)
    best = F.get("tried", F.lit(0))
    return t.select(
        "fact_id", "fact_type", "unit", F.col("common").alias("common_unit"), _converted().alias("converted"),
        "stated", best["u"].alias("proposed"), best["r"].alias("residual"), _unique(F.col("tried")).alias("unique"), (best["u"] == F.col("unit")).alias("agrees"),
    )


def found(facts: DataFrame, earlier: DataFrame, common_units: DataFrame) -> DataFrame:
    """fact_id of rows whose value is in another unit than the common one; zero loads are none."""
    t = decided(facts, earlier, common_units, only_doubtful=True)
    return t.where((F.col("unit") != F.col("common")) & ~((F.col("fact_type") == "exit_load") & (_converted() == 0))).select("fact_id").distinct()
