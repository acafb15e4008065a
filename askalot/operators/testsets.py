"""Robustness tests made of instances: which are fit, option conditions, feature orderings, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answer_patterns import OPTION_RE, QUESTION_RE, is_scale_option, is_special, is_substantive
from ..functions.binding import let, measures, remembered
from ..functions.hashing import order_key
from ..sources.shared import stored
from .instances import fill, formatted


def option_type(options: Column) -> Column:
    """'scale' if at least half of two or more options stand on a scale, else 'categorical'."""
    return F.when((F.size(options) >= 2) & (F.size(F.filter(options, is_scale_option)) * 2 >= F.size(options)), "scale").otherwise("categorical")


def surface_form_reason(options: Column, question: Column) -> Column:
    """Why answers of an instance get no variation; null if they do."""
    kept = F.filter(options, lambda o: ~is_special(o))
    return (
        F.when(F.size(options) < 2, "insufficient_options").when(F.size(kept) < 2, "all_special_values")
        .when(F.lower(question).rlike(QUESTION_RE), "ineligible_question_pattern")
        .when(F.exists(kept, lambda o: F.lower(o).rlike(OPTION_RE)), "ineligible_option_content")
    )


def options_context(instances: DataFrame) -> DataFrame:
    """Adds ``shown`` (substantive options), ``option_type``, ``reason`` (null if eligible) and the answer's index, natural and reversed (scales only).

    The hidden condition shows no options, so it has no index.
    """
    kinds = lambda rows: rows.withColumn("shown", F.filter(F.transform("options", lambda o: F.trim(o)), is_substantive)).withColumn("__kind", option_type(F.col("shown")))
    shown = kinds(instances) if instances.isStreaming else remembered(instances, "options", kinds, "shown", "__kind")  # lists are as many as questions
    at = F.array_position("shown", F.col("answer")) - 1
    reason = F.when(F.size("options") < 2, "insufficient_options").when(F.size("shown") < 2, "all_special_values").when(at < 0, "ground_truth_filtered")
    out = shown.withColumn("reason", reason).withColumn("option_type", F.when(F.col("reason").isNull(), F.col("__kind")).otherwise("unknown")).drop("__kind")
    eligible = F.col("reason").isNull()
    return out.withColumn("natural_index", F.when(eligible, at)).withColumn("reversed_index", F.when(eligible & (F.col("option_type") == "scale"), F.size("shown") - 1 - at))


def position_bias(tests: DataFrame) -> DataFrame:
    """(condition, position, n): where the right answer stands."""
    conditions = F.explode(F.array(F.struct(F.lit("shown_natural").alias("condition"), F.col("natural_index").alias("position")), F.struct(F.lit("shown_reversed").alias("condition"), F.col("reversed_index").alias("position")))).alias("x")
    return tests.select(conditions).select("x.condition", "x.position").where("position is not null").groupBy("condition", "position").agg(F.count(F.lit(1)).alias("n"))


def options_statistics(tests: DataFrame) -> DataFrame:
    """(measure, value, n) of the rows of ``options_context``: processed, by reason; of the eligible ones by type, number of options and survey, and those with a reversed condition."""
    ok = F.col("reason").isNull()
    of = lambda c: F.when(ok, c).cast("string")
    each = measures(
        ("processed", "all", 1), ("eligibility", F.coalesce("reason", F.lit("eligible")), 1), ("option_type", of(F.col("option_type")), 1), ("n_options", of(F.size("shown")), 1),
        ("survey", of(F.col("survey")), 1), ("with_reversed", of(F.when(F.col("reversed_index").isNotNull(), "all")), 1),
    )
    return tests.select(each).where("x.value is not null").groupBy("x.measure", "x.value").agg(F.sum("x.n").alias("n"))


#: Orderings that are tried until one is neither the original nor its reverse: windows of the same digest.
TRIES = 11


#: Lists of so many items are ordered by compiled code, a step for each item; longer ones by functions over arrays, which are interpreted and take several times as long.
FEW = 8


def _keyed(base: Column, k: Column | int, x: Column) -> Column:
    """An item behind the k-th window of its digest. Such texts are sorted, not pairs; an item that is null comes first."""
    at = F.lit(2 * k + 1) if isinstance(k, int) else 2 * k + 1
    return F.concat(F.substr(F.md5(F.concat(base, F.lit("|"), x)), at, F.lit(12)), x)


def _window(items: Column, base: Column, k: Column) -> Column:
    """The items in the order of the k-th window of their digests."""
    return F.transform(F.sort_array(F.transform(items, lambda x: _keyed(base, k, x))), lambda y: F.substr(y, F.lit(13)))


def with_windows(rows: DataFrame, windows: dict[str, tuple[Column, Column | int]]) -> DataFrame:
    """Adds for each name (base, k) the ``items`` in the order of that window, as ``_window`` does.

    What stands inside a function over arrays is interpreted, so keys are sorted in one step and cut in a second one.
    """
    n, x, columns = F.size("items"), F.col("items"), rows.columns
    places = [F.lit(j) for j in range(FEW)]

    def keys(base: Column, k: Column | int) -> Column:
        few = F.sort_array(F.array(*[_keyed(base, k, F.get(x, j)) for j in places]))  # nulls first: FEW - n of them stand for no item
        return F.when(n <= FEW, few).otherwise(F.sort_array(F.transform(x, lambda y: _keyed(base, k, y))))

    def cut(keyed: Column) -> Column:
        few = F.slice(F.array(*[F.substr(F.get(keyed, j), F.lit(13)) for j in places]), F.lit(FEW + 1) - n, n)
        return F.when(n <= FEW, few).otherwise(F.transform(keyed, lambda y: F.substr(y, F.lit(13))))

    based = rows.select("*", *[base.alias(f"__base_{name}") for name, (base, _) in windows.items()])
    keyed = based.select(*columns, *[keys(F.col(f"__base_{name}"), k).alias(f"__keys_{name}") for name, (_, k) in windows.items()])
    return keyed.select(*columns, *[cut(F.col(f"__keys_{name}")).alias(name) for name in windows])


def _seed_parts(seed: Column) -> tuple[Column, Column]:
    """What stands before the last '#' of a seed, and the number behind it."""
    k = F.substring_index(seed, "#", -1)
    return F.substr(seed, F.lit(1), F.length(seed) - F.length(k) - 1), k.cast("int")


def ordering_by_seed(items: Column, seed: Column) -> Column:
    """The items in the order that a recorded seed names: what stands before the last '#' is hashed with each item, the number behind it is the window."""
    base, k = _seed_parts(seed)
    return let(base, lambda own: let(k, lambda window: _window(items, own, window)))


def with_ordering_by_seed(rows: DataFrame, name: str) -> DataFrame:
    """Adds ``ordering_by_seed`` of the columns ``items`` and ``seed``, by compiled code where lists are short."""
    base, k = _seed_parts(F.col("seed"))
    return with_windows(rows.withColumn("__k", k), {name: (base, F.col("__k"))}).drop("__k")


def _fresh(ordering: Column, items: Column) -> Column:
    return (ordering != items) & (ordering != F.reverse(items))


def _seed_base(example_id: Column, i: int, seed: int) -> Column:
    return F.concat_ws("|", F.lit(str(seed)), example_id, F.lit(str(i)))


def random_ordering(name: str, first: Column, items: Column, example_id: Column, i: int, seed: int) -> Column:
    """(name, ordering, seed): the items by hash; of TRIES orderings the first that differs from the original and its reverse, else the last. ``first`` is the ordering of the first try. The seed makes it again."""
    base = _seed_base(example_id, i, seed)
    named = lambda ordering, k: F.struct(F.lit(name).alias("name"), ordering.alias("ordering"), F.concat(base, F.lit("#"), k.cast("string")).alias("seed"))
    digests = F.transform(items, lambda x: F.struct(F.md5(F.concat(base, F.lit("|"), x)).alias("digest"), x.alias("item")))
    window = lambda own, k: F.transform(F.sort_array(F.transform(own, lambda y: F.concat(F.substr(y["digest"], 2 * k + 1, F.lit(12)), y["item"]))), lambda y: F.substr(y, F.lit(13)))
    # A further window is only made where those before it are the original or its reverse.
    others = let(digests, lambda own: F.aggregate(F.sequence(F.lit(1), F.lit(TRIES - 1)), named(first, F.lit(0)), lambda found, k: F.when(_fresh(found["ordering"], items), found).otherwise(named(window(own, k), k))))
    return F.when(_fresh(first, items), named(first, F.lit(0))).otherwise(others)  # the first nearly always does


def ordering_reason(items: Column, options: Column, answer: Column) -> Column:
    """Why an instance gets no orderings; null if it does."""
    n = F.size(items)
    return (
        F.when(items.isNull(), "questions_not_dict").when(n < 3, F.concat(F.lit("insufficient_features_"), n.cast("string"))).when(options.isNull() | (F.size(options) < 2), "insufficient_options")
        .when(~F.coalesce(F.array_contains(options, answer), F.lit(False)), "ground_truth_not_in_options")
    )


#: Names of orderings: a third random one from five features on.
ORDERINGS = ("original", "reversed", "random_1", "random_2", "random_3")


def with_orderings(instances: DataFrame, items: Column, seed: int = 42, names: tuple[str, ...] = ORDERINGS) -> DataFrame:
    """Adds ``items``, ``n_features``, ``reason``, ``n_orderings`` (0 with a reason) and ``orderings``, an array of (name, ordering, seed) that is null with a reason.

    An instance stays one row, so what is counted or compared for each needs no shuffle, and what isn't used isn't made. ``names``: the orderings that are made.
    """
    rows = instances.withColumn("items", items).withColumn("reason", ordering_reason(F.col("items"), F.col("options"), F.col("answer")))
    x, n, ok, who = F.col("items"), F.size("items"), F.col("reason").isNull(), F.col("example_id")
    drawn = {name: i for i, name in enumerate(ORDERINGS[2:], 1) if name in names}
    # An item list is null with a reason: no ordering is made then.
    rows = with_windows(rows.withColumn("__all", x).withColumn("items", F.when(ok, x)), {f"__{name}": (_seed_base(who, i, seed), 0) for name, i in drawn.items()}) if drawn else rows.withColumn("__all", x)
    fixed = lambda name, ordering: F.struct(F.lit(name).alias("name"), ordering.alias("ordering"), F.lit(None).cast("string").alias("seed"))
    make = {"original": lambda: fixed("original", x), "reversed": lambda: fixed("reversed", F.reverse(x))}
    one = lambda name: make[name]() if name in make else random_ordering(name, F.col(f"__{name}"), x, who, drawn[name], seed)
    few = [name for name in names if name != "random_3"]
    each, k = F.array(*map(one, few)), F.lit(len(few))
    if "random_3" in names:
        each, k = F.when(n >= 5, F.array(*map(one, names))).otherwise(each), F.when(n >= 5, len(names)).otherwise(len(few))
    return rows.select(*instances.columns, F.col("__all").alias("items"), F.size("__all").alias("n_features"), "reason", F.when(ok, k).otherwise(0).alias("n_orderings"), F.when(ok, each).alias("orderings"))


def feature_orderings(instances: DataFrame, items: Column, seed: int = 42, ineligible: bool = False, keep_items: bool = False, names: tuple[str, ...] = ORDERINGS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(example_id, survey, options, n_features, reason, name, ordering, seed) of instances with three or more features whose answer is an option: original, reversed, two by hash, a third from five features on.

    ``seed`` is null for the first two. With ``ineligible``, the other instances come too, one row each with a ``reason`` and no ordering.
    With ``keep_items``, ``items`` come too, in their first order. ``names``: the orderings that are made; ``keep``: more columns of the instances.
    """
    own = [*keep, *(["items"] if keep_items else [])]
    rows = with_orderings(instances, items, seed, names).select("example_id", "survey", "options", "n_features", "reason", *own, F.explode_outer("orderings").alias("e"))
    return (rows if ineligible else rows.where("e is not null")).select("example_id", "survey", "options", "n_features", "reason", "e.name", "e.ordering", "e.seed", *own)


def sample(rows: DataFrame, n: int, seed: int, key: str = "example_id") -> DataFrame:
    return rows.orderBy(order_key(seed, F.col(key)), key).limit(n)


def sample_by_type(rows: DataFrame, n: int, seed: int, key: str = "example_id") -> DataFrame:
    """max(50, n // 3) of each option type, then others, n at most; scales come first."""
    rank = F.row_number().over(Window.partitionBy("option_type").orderBy(order_key(seed, F.col(key)), key))
    # Spark limits each type inside its tasks before it shuffles; what isn't among the first n of its type can't be taken.
    ranked = rows.withColumn("__r", rank).where(F.col("__r") <= n)
    first = F.when(F.col("__r") > max(50, n // 3), 2).when(F.col("option_type") == "scale", 0).otherwise(1)
    return ranked.orderBy(first, order_key(seed, F.col(key)), key).limit(n).drop("__r")


def sample_by_size(rows: DataFrame, size: str, n: int, seed: int, key: str = "example_id") -> DataFrame:
    """max(1, floor(n * share)) of each size, small sizes first; then others, n at most.

    The rows are read for the counts and for the sample, so they are stored, lest what they come from be made twice: give no columns that aren't wanted.
    """
    rows = stored(rows, "by_size")
    counts = rows.groupBy(size).agg(F.count(F.lit(1)).alias("__n"))
    shares = counts.crossJoin(counts.agg(F.sum("__n").alias("__all"))).select(size, F.greatest(F.lit(1), F.floor(F.col("__n") * n / F.col("__all"))).alias("__take"))
    rank = F.row_number().over(Window.partitionBy(size).orderBy(order_key(seed, F.col(key)), key))
    ranked = rows.withColumn("__r", rank).where(F.col("__r") <= n).join(shares, size)
    late = F.col("__r") > F.col("__take")
    return ranked.orderBy(late, F.when(~late, F.col(size)), order_key(seed, F.col(key)), key).limit(n).drop("__r", "__take")


def generate_options_context(instances: DataFrame, n: int | None = None, stratify: bool = True, seed: int = 42) -> DataFrame:
    """Eligible option tests, all or a sample, with ``conditions``: the answer's index is -1 where options are hidden."""
    rows = options_context(instances).where("reason is null")
    shown = F.array(F.lit("hidden"), F.lit("shown_natural"))
    rows = rows.withColumn("conditions", F.when(F.col("option_type") == "scale", F.concat(shown, F.array(F.lit("shown_reversed")))).otherwise(shown))
    if n is None:
        return rows
    return sample_by_type(rows, n, seed) if stratify else sample(rows, n, seed)


def ordering_text(name: str, template: str = "Q: {question}\nA: {answer}", questions: Column | None = None) -> Column:
    """An ordering (an array of question and answer) as text, a template filled for each feature."""
    return formatted(F.col(name) if questions is None else questions, lambda q, a: fill(template, {"question": q, "answer": a}), "\n")


def ordering_statistics(rows: DataFrame) -> DataFrame:
    """(measure, value, n) of the rows of ``with_orderings``: instances, eligible ones, by features, orderings in all and by number. No ordering is made for it."""
    ok, k = F.col("reason").isNull(), F.col("n_orderings")
    of = lambda c: F.when(ok, c).cast("string")
    each = measures(("processed", "all", 1), ("eligible", of(F.lit("all")), 1), ("n_features", of(F.col("n_features")), 1), ("orderings", of(F.lit("all")), k), ("n_orderings", of(k), 1))
    counted = rows.select(each).where("x.value is not null").groupBy("x.measure", "x.value").agg(F.sum("x.n").alias("n"))
    none = rows.sparkSession.createDataFrame([(m, "all", 0) for m in ("processed", "eligible", "orderings")], counted.schema)
    return counted.unionByName(none).groupBy("measure", "value").agg(F.sum("n").alias("n"))


def ordering_summary(orderings: DataFrame) -> DataFrame:
    """(survey, n_instances, n_orderings, avg_orderings) of the rows of ``feature_orderings``, and of all surveys together with a null survey."""
    per = orderings.where("ordering is not null").groupBy("survey", "example_id").agg(F.count(F.lit(1)).alias("k"))
    total = [F.count(F.lit(1)).alias("n_instances"), F.sum("k").alias("n_orderings"), F.round(F.avg("k"), 6).alias("avg_orderings")]
    return per.rollup("survey").agg(*total)
