"""Answer options said otherwise: synonyms, reorderings, pronouns; and surface-form tests made of them.

All rules are expressions over one option. Tests apply them to the distinct option lists, which are as many as
questions (times countries), and join the result back.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answer_patterns import OPTION_RE, is_special
from ..functions.binding import measures, remembered
from ..functions.hashing import order_key
from ..functions.variation_rules import PHRASES, PRONOUNS, REORDERED, WORDS
from .testsets import surface_form_reason

TYPES = ("synonym", "reorder", "pronoun")
NONE = "array<struct<variation:string,rule:string>>"


def phrase_rules() -> dict[str, list[tuple[str, str]]]:
    """By an option in lower case: (variation, rule), both directions, in the order of the rules."""
    found: dict[str, list[tuple[str, str]]] = {}
    for a, b in PHRASES:
        found.setdefault(a.lower(), []).append((b, f"'{a}' <-> '{b}'"))
        found.setdefault(b.lower(), []).append((a, f"'{b}' <-> '{a}'"))
    return found


def reorder_rules() -> dict[str, list[tuple[str, str]]]:
    """Both directions; a later pair takes the place of an earlier one with the same option."""
    found = {}
    for a, b in REORDERED:
        found[a.lower()] = [(b, f"'{a}' <-> '{b}'")]
        found[b.lower()] = [(a, f"'{b}' <-> '{a}'")]
    return found


def pronoun_rules() -> dict[str, list[tuple[str, str]]]:
    """Pronouns put in (of pairs with the same option the last), then pronouns taken out."""
    put_in = {a.lower(): (b, f"'{a}' -> '{b}'") for a, b in PRONOUNS}
    out = {b.lower(): (a, f"'{b}' -> '{a}'") for a, b in PRONOUNS}
    return {k: [m[k] for m in (put_in, out) if k in m] for k in {**put_in, **out}}


def _known(option: Column, rules: dict[str, list[tuple[str, str]]]) -> Column:
    """Entries of a constant map."""
    entries = json.dumps({k: [{"variation": v, "rule": r} for v, r in own] for k, own in rules.items()})
    return F.coalesce(F.try_element_at(F.from_json(F.lit(entries), f"map<string,{NONE}>"), F.lower(option)), F.array().cast(NONE))


def word_index() -> dict[str, list[int]]:
    """Where a word in lower case begins a side of a rule for words: the rules' numbers."""
    found: dict[str, set[int]] = {}
    for k, pair in enumerate(WORDS):
        for side in pair:
            found.setdefault(re.match(r"\w+", side.lower())[0], set()).add(k)
    return {w: sorted(own) for w, own in found.items()}


def _words(option: Column) -> Column:
    """For each pair of words the first one replaced, or else the second one; nothing where neither occurs or nothing changes.

    The option's own words name the rules that can apply, so an option costs what its words do and not what there are rules.
    """
    whole = lambda w: rf"(?i)\b{re.escape(w)}\b"
    entries = [{"a": a, "b": b, "pa": whole(a), "pb": whole(b), "ra": f"'{a}' -> '{b}'", "rb": f"'{b}' -> '{a}'"} for a, b in WORDS]
    rules = F.from_json(F.lit(json.dumps(entries)), "array<struct<a:string,b:string,pa:string,pb:string,ra:string,rb:string>>")
    index = F.from_json(F.lit(json.dumps(word_index())), "map<string,array<int>>")
    own = F.array_distinct(F.regexp_extract_all(F.lower(option), F.lit(r"([A-Za-z0-9_]+)"), F.lit(1)))
    named = F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform(own, lambda w: F.try_element_at(index, w)), lambda x: x.isNotNull()))))
    make = lambda r, pattern, to, rule: F.struct(F.regexp_replace(option, r[pattern], r[to]).alias("variation"), r[rule].alias("rule"))
    one = lambda r: F.when(F.regexp_like(option, r["pa"]), make(r, "pa", "b", "ra")).when(F.regexp_like(option, r["pb"]), make(r, "pb", "a", "rb"))
    return F.filter(F.transform(named, lambda k: one(F.get(rules, k))), lambda x: x.isNotNull() & (x["variation"] != option))


def is_ineligible(option: Column) -> Column:
    return is_special(option) | F.lower(option).rlike(OPTION_RE)


def variations(option: Column, kind: str) -> Column:
    """(variation, rule) of an option, repeated variations once; none for special answers, parties, faiths and the like."""
    found = {"synonym": lambda: F.concat(_known(option, phrase_rules()), _words(option)), "reorder": lambda: _known(option, reorder_rules()), "pronoun": lambda: _known(option, pronoun_rules())}[kind]()
    return F.when(is_ineligible(option), F.array().cast(NONE)).otherwise(found)


def first_of_each(found: Column) -> Column:
    return F.filter(found, lambda x, i: ~F.exists(F.slice(found, F.lit(1), i), lambda y: y["variation"] == x["variation"]))


def all_variations(options: DataFrame) -> DataFrame:
    """(option, type, pos, variation, rule) of the distinct values of ``option``."""
    found = options.select("option").where("option is not null").distinct()
    for kind in TYPES:
        found = found.withColumn(kind, variations(F.col("option"), kind))
    for kind in TYPES:
        found = found.withColumn(kind, first_of_each(F.col(kind)))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("type"), F.col(k).alias("found")) for k in TYPES])).alias("x")
    return found.select("option", each).select("option", "x.type", F.posexplode("x.found").alias("pos", "v")).select("option", "type", "pos", "v.variation", "v.rule")


def coverage(options: DataFrame) -> DataFrame:
    """(n_options, synonym, reorder, pronoun, any_type): how many distinct options have a variation."""
    found = options.select("option").where("option is not null").distinct()
    for kind in TYPES:
        found = found.withColumn(kind, F.size(variations(F.col("option"), kind)) > 0)
    return found.agg(F.count(F.lit(1)).alias("n_options"), *[F.count_if(k).alias(k) for k in TYPES], F.count_if(F.greatest(*TYPES)).alias("any_type"))


def substantive(options: Column) -> Column:
    return F.filter(options, lambda o: ~is_special(o))


def option_sets(lists: DataFrame) -> DataFrame:
    """Adds to distinct ``options``: ``original`` and for each type an array of the first variation of each option or null, and ``rules``.

    Of equal options in a list, the last one takes the variation.
    """
    rows = lists.withColumn("original", substantive(F.col("options")))
    for kind in TYPES:
        rows = rows.withColumn(f"__{kind}", F.transform("original", _first(kind)))
    later = lambda o, i: F.exists(F.slice("original", i + 2, F.size("original")), lambda x: x == o)
    rows = rows.withColumn("__last", F.transform("original", lambda o, i: ~later(o, i)))
    for kind in TYPES:
        rows = rows.withColumn(f"__{kind}", F.zip_with(f"__{kind}", "__last", lambda v, last: F.when(last, v)))
    rules = [F.filter(F.transform(f"__{k}", _rule(k)), lambda x: x.isNotNull()) for k in TYPES]
    rows = rows.withColumn("rules", F.concat(*rules))
    return rows.select(*lists.columns, "original", *[F.transform(f"__{k}", lambda v: v["variation"]).alias(k) for k in TYPES], "rules")


def _first(kind: str):
    return lambda o: F.try_element_at(variations(o, kind), F.lit(1))


def _rule(kind: str):
    return lambda v, i: F.concat(F.lit(f"{kind}_"), i.cast("string"), F.lit(": "), v["rule"])


def surface_forms(instances: DataFrame) -> DataFrame:
    """Adds ``reason`` (null if eligible), ``original``, the three sets, ``rules``, ``has_<type>`` and ``ground_truth_index`` (-1 if the answer isn't substantive).

    Rows without an id, a question, options or an answer go. Ineligible rows have no sets. On a stream each row makes its own sets, so no state
    is held and nothing waits; a batch remembers those of lists that occur often.
    """
    whole = instances.where("example_id is not null and target_question is not null and options is not null and answer is not null")
    rows = whole.withColumn("reason", surface_form_reason(F.col("options"), F.col("target_question")))
    rows = option_sets(rows) if instances.isStreaming else remembered(rows, "options", option_sets, "original", *TYPES, "rules")
    ok = F.col("reason").isNull()
    for kind in TYPES:
        rows = rows.withColumn(kind, F.when(ok, F.col(kind))).withColumn(f"has_{kind}", ok & F.exists(kind, lambda v: v.isNotNull()))
    rows = rows.withColumn("rules", F.when(ok, F.col("rules"))).withColumn("original", F.when(ok, F.col("original")))
    for kind in TYPES:
        rows = rows.withColumn(f"has_{kind}", F.coalesce(f"has_{kind}", F.lit(False)))
    return rows.withColumn("ground_truth_index", F.when(ok, F.array_position("original", F.col("answer")) - 1).cast("int"))


def has_any() -> Column:
    return F.col("has_synonym") | F.col("has_reorder") | F.col("has_pronoun")


def sample_by_variation(rows: DataFrame, n: int, seed: int, key: str = "example_id") -> DataFrame:
    """min(50, n // 6) each with a pronoun, then a reordered, then a synonym variation among those not yet taken, then others, n at most.

    One pass: of each kind and of all rows the first n + 3 min(50, n // 6) by hash are all that can be taken, and Spark cuts to them
    inside its tasks; the three steps are windows over those few rows.
    """
    most, flags = min(50, n // 6), [f"has_{k}" for k in ("pronoun", "reorder", "synonym")]
    order = ["__order", key]
    own = rows.withColumn("__order", order_key(seed, F.col(key)))
    group = F.explode(F.filter(F.array(F.lit("all"), *[F.when(F.col(f), f) for f in flags]), lambda g: g.isNotNull()))
    rank = F.row_number().over(Window.partitionBy("__group").orderBy(*order))
    few = own.withColumn("__group", group).withColumn("__r", rank).where(F.col("__r") <= n + 3 * most).drop("__group", "__r").dropDuplicates([key])
    few = few.withColumn("__taken", F.lit(False))
    for f in flags:
        free = F.col(f) & ~F.col("__taken")
        few = few.withColumn("__free", free).withColumn("__r", F.row_number().over(Window.partitionBy("__free").orderBy(*order)))
        few = few.withColumn("__taken", F.col("__taken") | (F.col("__free") & (F.col("__r") <= most)))
    return few.orderBy(~F.col("__taken"), *order).limit(n).select(*rows.columns)


def generate(instances: DataFrame, n: int | None = None, require_variations: bool = True, stratify: bool = True, seed: int = 42) -> DataFrame:
    """Eligible surface-form tests, all or a sample."""
    rows = surface_forms(instances).where("reason is null")
    if require_variations:
        rows = rows.where(has_any())
    if n is None:
        return rows
    return sample_by_variation(rows, n, seed) if stratify else rows.orderBy(order_key(seed, F.col("example_id")), "example_id").limit(n)


def statistics(tests: DataFrame) -> DataFrame:
    """(measure, value, n): rows processed, eligible, by reason, slots and filled slots by type, instances by survey."""
    filled = lambda k: F.coalesce(F.size(F.filter(k, lambda v: v.isNotNull())), F.lit(0))
    slots = F.when(F.col("reason").isNull(), F.size("original")).otherwise(0)
    ok = F.col("reason").isNull()
    each = measures(
        ("processed", "all", 1), ("eligibility", F.coalesce("reason", F.lit("eligible")), 1), ("survey", F.col("survey"), 1), ("slots", "all", slots),
        *[("filled", k, F.when(ok, filled(k)).otherwise(0)) for k in TYPES], *[("with_variation", k, F.col(f"has_{k}").cast("int")) for k in TYPES],
    )
    return tests.select(each).groupBy("x.measure", "x.value").agg(F.sum("x.n").alias("n"))


def variants_at(tests: DataFrame, index: Column) -> DataFrame:
    """(example_id, original, synonym, reorder, pronoun) at one index (from 0) of the parallel sets."""
    at = index.cast("int") + 1
    return tests.where("reason is null").select("example_id", *[F.try_element_at(k, at).alias(k) for k in ("original", *TYPES)])
