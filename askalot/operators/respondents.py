"""The row-local form of profiles and instances: one row per respondent with all answers in an array.

Decoding, drawing and assembling are expressions over that array, so a plan has one scan of the survey and no
exchange, and the same code runs on a stream. The draws equal those of the long form in ``profiles``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binding import each_of, let
from ..functions.hashing import order_key
from .decode import integer_key, is_missing, written_integer
from .profiles import ProfileConfig


def book(variables: DataFrame, values: DataFrame, codes: list[str]) -> DataFrame:
    """The codebook as one row: ``book``, an array in the order of ``codes``, and ``book_sections``, all sections by position.

    A code that stands in several sections takes the last one, as the reverse index of sections does; of labels of one raw value the
    first counts. ``sampleable`` is taken to be true where the codebook doesn't say. Labels, whether they mean no answer, options and
    which question texts are ``repeated`` are made ready here, once.
    """
    at = F.array_position(F.array(*map(F.lit, codes)), F.col("code")).cast("int")
    return _books(variables.where(F.col("code").isin(codes)).withColumn("at", at), values, [])


def books(variables: DataFrame, values: DataFrame, codes: DataFrame) -> DataFrame:
    """``book`` for many surveys, a row each with ``survey``, which all three tables have; ``codes`` (survey, code, at) says where a survey's answers stand (from 1)."""
    return _books(variables.join(codes.select("survey", "code", "at"), ["survey", "code"]), values, ["survey"])


def _books(variables: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    key = [*by, "code"]
    ordered = F.array_sort(F.collect_list(F.struct("label_pos", "label", "raw")))
    lists = values.groupBy(*key).agg(ordered.alias("l")).select(*key, F.size("l").alias("n_labels"), F.transform(F.filter("l", lambda x: ~is_missing(x["label"])), lambda x: x["label"]).alias("options"))
    single = values.groupBy(*key, "raw").agg(F.min_by("label", "label_pos").alias("label")).where("label is not null")
    labels = single.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("raw", _labelled(F.col("label"))))).alias("labels"))
    flag = lambda name: F.coalesce(F.col(name), F.lit(True)) if name in variables.columns else F.lit(True)
    last = F.max_by(F.struct("section", "section_pos", "code", "var_pos", "question", flag("sampleable").alias("sampleable"), "at"), F.struct("section_pos", "var_pos"))
    own = variables.groupBy(*key).agg(last.alias("v")).withColumn("repeated", F.count(F.lit(1)).over(Window.partitionBy(*by, "v.question")) > 1)
    each = own.join(lists, key, "left").join(labels, key, "left")
    kept = [F.col(f"v.{c}").alias(c) for c in ("section", "section_pos", "code", "var_pos", "question", "sampleable")]
    rest = ["repeated", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("options", F.array().cast("array<string>")).alias("options"), F.map_entries("labels").alias("labels")]
    one = each.select(*by, F.struct(F.col("v.at").alias("at"), *kept, *rest).alias("b")).groupBy(*by).agg(F.array_sort(F.collect_list("b")).alias("book"))
    entries = F.transform("book", lambda b: b.withField("labels", F.map_from_entries(F.coalesce(b["labels"], F.array().cast("array<struct<key:string,value:struct<label:string,missing:boolean>>>")))))
    own = F.transform("book", lambda b: F.struct(b["section_pos"].alias("section_pos"), b["section"].alias("section")))
    return one.select(*by, entries.alias("book"), F.transform(F.array_sort(F.array_distinct(own)), lambda s: s["section"]).alias("book_sections"))


def _labelled(label: Column) -> Column:
    return F.struct(label.alias("label"), is_missing(label).alias("missing"))


def look_up(labels: Column, raw: Column, strict_int: bool = False) -> Column:
    """(label, missing) of a raw answer: by itself, else by its integer part (with ``strict_int``: only if written as an integer), else the raw answer."""
    key = written_integer(raw) if strict_int else integer_key(raw)
    return F.coalesce(F.try_element_at(labels, raw), let(key, lambda k: F.when(k.isNotNull(), F.try_element_at(labels, k))), _labelled(raw))


def answer_rows(wide: DataFrame, codebook: DataFrame, codes: list[str], keys: tuple[str, ...] = ("respondent_id", "country")) -> DataFrame:
    """keys, ``book_sections`` and ``answers``: for each answer that isn't null its variable, raw value, label (lookup A), target label (lookup B), whether these mean no answer, options.

    Lookup A: the label of a raw answer by itself, else by its integer part, else the raw answer; B: by its integer part only if written as an integer.

    The codebook is one row, joined to each respondent; null answers and codes that the codebook lacks go.
    """
    raws = F.array(*[F.col(f"`{c}`").cast("string") for c in codes])
    return wide.crossJoin(codebook).select(*keys, "book_sections", _answers(raws).alias("answers"))


def raw_rows(wide: DataFrame, survey: str, codes: list[str]) -> DataFrame:
    """(survey, respondent_id, country, raws): a survey's answers in the order of ``codes``, so that surveys of different columns can stand in one table."""
    return wide.select(F.lit(survey).alias("survey"), F.col("respondent_id").cast("string").alias("respondent_id"), F.col("country").cast("string").alias("country"), F.array(*[F.col(f"`{c}`").cast("string") for c in codes]).alias("raws"))


def keyed_answer_rows(raws: DataFrame, codebooks: DataFrame) -> DataFrame:
    """``answer_rows`` of many surveys: ``raw_rows`` of each, united, and their ``books``."""
    return raws.join(codebooks, "survey").select("survey", "respondent_id", "country", "book_sections", _answers(F.col("raws")).alias("answers"))


def _answers(raws: Column) -> Column:
    def answer(b: Column, raw: Column, found: Column, target: Column) -> Column:
        kept = [b[c].alias(c) for c in ("section", "section_pos", "code", "var_pos", "question", "sampleable", "repeated", "n_labels")]
        return F.struct(*kept, raw.alias("raw"), found["label"].alias("label"), target["label"].alias("target_label"), found["missing"].alias("missing"), target["missing"].alias("target_missing"), b["options"].alias("options"))

    def looked_up(b: Column, raw: Column) -> Column:
        """Most answers have a label by themselves, which both lookups find at once."""
        others = let(look_up(b["labels"], raw), lambda found: let(look_up(b["labels"], raw, True), lambda target: answer(b, raw, found, target)))
        return let(F.try_element_at(b["labels"], raw), lambda own: F.when(own.isNotNull(), answer(b, raw, own, own)).otherwise(others))

    given = lambda rs: F.filter("book", lambda b: F.element_at(rs, b["at"]).isNotNull())
    return let(raws, lambda rs: F.transform(given(rs), lambda b: let(F.element_at(rs, b["at"]), lambda raw: looked_up(b, raw))))


@dataclass(frozen=True)
class Draw:
    """What a profile is drawn from and how: exclusions, codes that always come first (in order), a final shuffle."""

    config: ProfileConfig
    excluded: tuple[str, ...] = ()
    always: tuple[str, ...] = ()
    shuffle: bool = False

    def exclude(self, codes: list[str], add: bool = True) -> Draw:
        """Exclusions replaced by ``codes``, or with ``add`` joined with them."""
        return replace(self, excluded=tuple(dict.fromkeys([*(self.excluded if add else ()), *codes])))


def check_draw(variables: DataFrame, draw: Draw) -> dict[str, list[str]]:
    """Raises ValueError if the pool can't satisfy the draw, or a code that must come is unknown or excluded. Returns unknown exclusions.

    Reads the codebook alone: its sections' sizes, a number each.
    """
    known = {r["code"] for r in variables.select("code").distinct().collect()}
    unknown = [c for c in draw.always if c not in known]
    if unknown:
        raise ValueError(f"unknown features: {unknown}")
    if both := [c for c in draw.always if c in draw.excluded]:
        raise ValueError(f"always included and excluded: {both}")
    rows = variables.where(~F.col("code").isin([*draw.excluded, *draw.always, ""]))
    if "sampleable" in variables.columns:
        rows = rows.where("sampleable")
    sizes = {r["section"]: r["count"] for r in rows.groupBy("section").count().collect()}
    if draw.config.n_sections > len(sizes):
        raise ValueError(f"{draw.config.n_sections} sections asked for, {len(sizes)} have features")
    if sizes and draw.config.m_features > min(sizes.values()):
        raise ValueError(f"{draw.config.m_features} features asked for, the smallest section has {min(sizes.values())}")
    return {"unknown_exclusions": [c for c in draw.excluded if c not in known]}


#: Inside functions over arrays ``array_contains`` leaves its loop by an exception, which costs more than all else there.
def _among(value: Column, array: Column) -> Column:
    return F.exists(array, lambda x: x == value)


def _drawable(draw: Draw, more: Column | None = None) -> Callable[[Column], Column]:
    out = [*draw.excluded, *draw.always, ""]
    ok = lambda a: a["sampleable"] & ~a["missing"] & ~a["code"].isin(out)
    return ok if more is None else lambda a: ok(a) & ~F.coalesce(_among(a["code"], more), F.lit(False))


def pool_of(answers: Column, draw: Draw, more: Column | None = None) -> Column:
    """The valid answers that may be drawn: sampleable, neither excluded nor always included, nor in ``more`` (an array of codes)."""
    return F.filter(answers, _drawable(draw, more))


def _places(answers: Column, ok: Callable[[Column], Column]) -> Column:
    """Where in ``answers`` those stand that are ok (from 0). Draws handle places, answers are copied when they are drawn."""
    return F.filter(F.transform(answers, lambda a, i: F.when(ok(a), i)), lambda i: i.isNotNull())


def sections_of(sections: Column, rid: Column, draw: Draw, n: int) -> Column:
    """The first n sections by hash. Ranks ignore n, so smaller draws nest in larger ones."""
    keyed = F.transform(sections, lambda s: F.struct(order_key(draw.config.seed, rid, "S", s).alias("key"), s.alias("section")))
    return F.transform(F.slice(F.sort_array(keyed), 1, n), lambda x: x["section"])


def first_of(answers: Column, pool: Column, section: Column, rid: Column, seed: int, m: int, salt: str = "") -> Column:
    """(at, pick): of the answers at the places ``pool`` the first m of a section by hash, ``pick`` from 1."""
    who = F.concat(rid, F.lit(salt)) if salt else rid
    own = F.filter(pool, lambda i: F.get(answers, i)["section"] == section)
    keyed = F.transform(own, lambda i: F.struct(order_key(seed, who, section, F.get(answers, i)["code"]).alias("key"), i.alias("at")))
    return F.transform(F.slice(F.sort_array(keyed), 1, m), lambda x, i: F.struct(x["at"].alias("at"), (i + 1).alias("pick")))


def _taken(answers: Column, drawn: Column) -> Column:
    """The answers drawn (at, pick), each with ``pick``."""
    return F.transform(drawn, lambda x: F.get(answers, x["at"]).withField("pick", x["pick"]))


def with_profile(rows: DataFrame, draw: Draw, name: str = "features", more: str | None = None, pool_sections: list[str] | str | None = None,
                 made: Callable[[Column, Column], Column] = _taken) -> DataFrame:
    """Adds the profile: always-included answers first, then those drawn by section in codebook order, or all by hash; each with ``pick``.

    ``more``: a column with an array of codes that may not be drawn in that row. ``pool_sections``: the sections that have
    features left, where exclusions empty some, or the name of a column with an array of them. ``made``: what the profile is made to, of the
    answers and what is drawn (at, pick); without a shuffle.
    """
    rid, seed = F.col("respondent_id"), draw.config.seed
    left = (lambda s: _among(s, F.col(pool_sections))) if isinstance(pool_sections, str) else (lambda s: s.isin(pool_sections))
    sections = F.col("book_sections") if pool_sections is None else F.filter("book_sections", left)

    def drawn(answers: Column, pool: Column) -> Column:
        chosen = sections_of(sections, rid, draw, draw.config.n_sections)
        ordered = let(chosen, lambda own: F.filter(sections, lambda s: _among(s, own)))
        return F.flatten(F.transform(ordered, lambda s: first_of(answers, pool, s, rid, seed, draw.config.m_features)))

    def whole(answers: Column) -> Column:
        found = let(_places(answers, _drawable(draw, F.col(more) if more else None)), lambda pool: drawn(answers, pool))
        first = [_named(answers, code) for code in draw.always]
        return let(F.concat(*first, found) if first else found, lambda own: made(answers, own))

    found = let(F.col("answers"), whole)
    return rows.withColumn(name, shuffled(found, rid, seed) if draw.shuffle else found)


def with_asked(rows: DataFrame, draw: Draw, more: str | None = None, pool_sections: list[str] | str | None = None) -> DataFrame:
    """Adds ``questions``: the profile ``asked``, for which no more of its answers is copied than question and label."""
    slim = lambda answers, drawn: asked(F.transform(drawn, lambda x: let(F.get(answers, x["at"]), lambda a: F.struct(*[a[c].alias(c) for c in ("question", "label", "repeated")]))))
    if draw.shuffle:
        return with_profile(rows, draw, "__features", more, pool_sections).withColumn("questions", asked(F.col("__features"))).drop("__features")
    return with_profile(rows, draw, "questions", more, pool_sections, slim)


def _named(answers: Column, code: str) -> Column:
    """(at, pick) of the valid answer to one variable as an array of one or none, with pick 0."""
    return F.transform(_places(answers, lambda a: (a["code"] == code) & ~a["missing"]), lambda i: F.struct(i.alias("at"), F.lit(0).alias("pick")))


def shuffled(features: Column, rid: Column, seed: int) -> Column:
    keyed = F.transform(features, lambda a: F.struct(order_key(seed, rid, "F", a["code"]).alias("key"), a["code"].alias("code"), a.alias("a")))
    return F.transform(F.sort_array(keyed), lambda x: x["a"])


def with_expanded(rows: DataFrame, draw: Draw, add_sections: int, add_features: int, features: str = "features", name: str = "expanded") -> DataFrame:
    """Adds a profile grown: all its features, then ``add_features`` more of each section it has, then m + ``add_features`` of ``add_sections`` new ones.

    The draw of a grown part has a salt of its own; target exclusions, the shuffle and the check of m don't apply to it.
    """
    rid, seed = F.col("respondent_id"), draw.config.seed
    salt = f"_expand_{add_sections}_{add_features}"
    answers = F.col("answers")
    pick = lambda pool, own, m: _taken(answers, F.flatten(F.transform(F.filter("book_sections", lambda s: _among(s, own)), lambda s: first_of(answers, pool, s, rid, seed, m, salt))))

    def grown(kept: Column) -> Column:
        has = F.transform(kept, lambda a: a["code"])
        old = F.array_distinct(F.transform(F.filter(kept, lambda a: a["pick"] > 0), lambda a: a["section"]))
        pool = let(has, lambda own: _places(answers, _drawable(draw, own)))

        def parts(pool: Column, old: Column) -> Column:
            fresh = F.filter("book_sections", lambda s: ~_among(s, old))
            new = sections_of(fresh, F.concat(rid, F.lit(salt)), draw, add_sections)
            return F.concat(kept, pick(pool, old, add_features), let(new, lambda own: pick(pool, own, draw.config.m_features + add_features)))

        return let(pool, lambda p: let(old, lambda o: parts(p, o)))

    return rows.withColumn(name, let(F.col(features), grown))


def asked(features: Column) -> Column:
    """(question, answer) in order; equal question texts collapse: first position, last label. Only those are looked for that the codebook holds more than once."""
    def collapse(own: Column) -> Column:
        one = lambda a, i: ~a["repeated"] | ~F.exists(F.slice(own, F.lit(1), i), lambda b: b["question"] == a["question"])
        last = lambda q: F.element_at(F.filter(own, lambda b: b["question"] == q), -1)["label"]
        return F.transform(F.filter(own, one), lambda a: F.struct(a["question"].alias("question"), F.when(a["repeated"], last(a["question"])).otherwise(a["label"]).alias("answer")))

    return let(features, collapse)


def with_questions(rows: DataFrame) -> DataFrame:
    """Rows with at least one of their ``questions``. A plain filter would be pushed below and compute the profile a second time."""
    others = [c for c in rows.columns if c != "questions"]
    return each_of(rows, F.array(F.when(F.size("questions") > 0, F.col("questions"))), "questions", *others)


def base_id(survey: str | Column, respondent_id: Column, code: Column) -> Column:
    """{survey}_{respondent}_{code}, the survey left out if empty; blanks and slashes as underscores."""
    name = F.nullif(survey if isinstance(survey, Column) else F.lit(survey), F.lit(""))
    return F.translate(F.concat_ws("_", name, respondent_id, code), " /", "__")


def with_answer(options: Column, answer: Column) -> Column:
    """An answer that isn't an option is appended."""
    return F.when(F.array_contains(options, answer), options).otherwise(F.concat(options, F.array(answer)))


def instances(rows: DataFrame, targets: list[str], draw: Draw, survey: str, exclusions: DataFrame | None = None, country_options: DataFrame | None = None,
              pool_sections: list[str] | None = None) -> DataFrame:
    """One row per respondent and target with a valid answer.

    Targets are no features. ``exclusions`` (target_code, excluded: array of codes) bar features for one target alone; ranks don't
    depend on the target, so targets without exclusions share one profile. ``country_options`` (country, code, options) replace the
    codebook's options where they have the respondent's country; an empty list stays empty. Both tables have a row per target at most
    (times countries), and Spark picks the join by their size.
    """
    own = draw.exclude(targets)
    held = F.filter("answers", lambda a: a["code"].isin(targets) & ~a["target_missing"] & (a["n_labels"] > 0))
    if exclusions is None:  # one profile serves all targets of a respondent
        rows = with_asked(rows, own, pool_sections=pool_sections).select("respondent_id", "country", "answers", "questions")
        # Rows without questions have no targets: a filter on questions would compute them a second time.
        each = each_of(rows, F.when(F.size("questions") > 0, held), "t", "respondent_id", "country", "questions")
    else:
        each = each_of(rows, held, "t", "respondent_id", "country", "answers", "book_sections")
        each = each.join(exclusions.select(F.col("target_code").alias("__t"), "excluded"), F.col("t.code") == F.col("__t"), "left")
        each = with_asked(each, own, "excluded", pool_sections).select("t", "respondent_id", "country", "questions")
        each = with_questions(each)
    options = F.col("t.options")
    if country_options is not None:
        listed = country_options.select(F.col("country").alias("__c"), F.col("code").alias("__code"), F.col("options").alias("__options"))
        each = each.join(listed, (F.col("country") == F.col("__c")) & (F.col("t.code") == F.col("__code")), "left")
        options = F.coalesce("__options", "t.options")
    return _shown(each, options, survey, draw)


def _shown(each: DataFrame, options: Column, survey: str, draw: Draw) -> DataFrame:
    """The columns of instances, of rows with ``questions`` and a target ``t``."""
    base = base_id(survey, F.col("respondent_id"), F.col("t.code"))
    kind = draw.config.profile_type
    return each.select(
        F.concat_ws("_", base, F.lit(kind)).alias("example_id"), base.alias("base_id"), F.lit(survey).alias("survey"), F.col("respondent_id").alias("id"), "country", "questions",
        F.col("t.question").alias("target_question"), F.col("t.code").alias("target_code"), F.col("t.section").alias("target_section"), F.col("t.target_label").alias("answer"),
        F.col("t.raw").alias("answer_raw"), with_answer(options, F.col("t.target_label")).alias("options"), F.lit(kind).alias("profile_type"),
    )


def direct_instances(wide: DataFrame, codebook: DataFrame, codes: list[str], targets: list[str], draw: Draw, survey: str) -> DataFrame:
    """``instances`` of all respondents of ``wide``, made of raw answers and the codebook: the same rows as of ``answer_rows``, for a fraction of the work.

    What doesn't depend on the respondent is made ready in the codebook's one row: the variables of each section that may be drawn, and the targets. So of a respondent only
    the sections drawn are looked at, and no answer is decoded that isn't shown or may be. Functions over arrays are interpreted, so their steps are what counts.
    """
    own = draw.exclude(targets)
    if own.always or own.shuffle:
        return instances(answer_rows(wide, codebook, codes), targets, draw, survey)
    out = [*own.excluded, ""]
    entry = lambda b, *names: F.struct(*[b[c].alias(c) for c in ("at", "code", "question", "labels", *names)])
    drawable = lambda s: F.transform(F.filter("book", lambda b: (b["section"] == s) & b["sampleable"] & ~b["code"].isin(out)), lambda b: entry(b, "repeated"))
    asked_for = F.transform(F.filter("book", lambda b: b["code"].isin(targets) & (b["n_labels"] > 0)), lambda b: entry(b, "section", "options"))
    ready = codebook.select(F.transform("book_sections", lambda s: F.struct(s.alias("section"), drawable(s).alias("entries"))).alias("pool"), asked_for.alias("targets"))
    rows = wide.select("respondent_id", "country", F.array(*[F.col(f"`{c}`").cast("string") for c in codes]).alias("raws")).crossJoin(ready)
    rid, seed = F.col("respondent_id"), own.config.seed
    kept = lambda array: F.filter(array, lambda x: x.isNotNull())
    labelled = lambda e, strict, body: let(F.element_at("raws", e["at"]), lambda raw: F.when(raw.isNotNull(), let(look_up(e["labels"], raw, strict), lambda x: F.when(~x["missing"], body(x["label"], raw)))))

    def first(section: Column) -> Column:
        """The first answers of a section by hash."""
        keyed = lambda e: labelled(e, False, lambda label, raw: F.struct(order_key(seed, rid, section["section"], e["code"]).alias("key"), e["question"].alias("question"), label.alias("label"), e["repeated"].alias("repeated")))
        return F.slice(F.sort_array(kept(F.transform(section["entries"], keyed))), 1, own.config.m_features)

    ranked = F.transform("pool", lambda p, i: F.struct(order_key(seed, rid, "S", p["section"]).alias("key"), i.alias("i")))
    chosen = F.sort_array(F.transform(F.slice(F.sort_array(ranked), 1, own.config.n_sections), lambda x: x["i"]))
    questions = asked(F.flatten(F.transform(chosen, lambda i: first(F.get("pool", i)))))
    held = kept(F.transform("targets", lambda e: labelled(e, True, lambda label, raw: F.struct(*[e[c].alias(c) for c in ("code", "question", "section", "options")], raw.alias("raw"), label.alias("target_label")))))
    drawn = rows.select("respondent_id", "country", "raws", "targets", questions.alias("questions"))
    each = each_of(drawn, F.when(F.size("questions") > 0, held), "t", "respondent_id", "country", "questions")
    return _shown(each, F.col("t.options"), survey, own)


def full_dict(rows: DataFrame) -> DataFrame:
    """Instances with what a reader needs on top, and the rest in a nested ``_metadata``."""
    top = ["example_id", "survey", "id", "country", "questions", "target_question", "target_code", "answer", "options"]
    rest = ["base_id", "target_section", "answer_raw", "profile_type"]
    return rows.select(*top, F.struct(*rest, F.size("questions").alias("n_features")).alias("_metadata"))


def target_rows(variables: DataFrame, values: DataFrame, targets: list[str] | None = None) -> DataFrame:
    """(code, section, question, n_options, options): targets with labels; of a code in several sections the first. Without ``targets``, all sampleable ones."""
    own = variables if targets is None else variables.where(F.col("code").isin(targets))
    if targets is None and "sampleable" in variables.columns:
        own = own.where("sampleable")
    first = own.groupBy("code").agg(F.min_by(F.struct("section", "question"), F.struct("section_pos", "var_pos")).alias("v"))
    # One sort of a variable's labels; labels that mean no answer are told apart afterwards.
    listed = values.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("label_pos", "label"))).alias("all"))
    kept = F.transform(F.filter("all", lambda x: ~is_missing(x["label"])), lambda x: x["label"])
    return first.join(listed, "code").select("code", "v.section", "v.question", F.size("all").alias("n_options"), kept.alias("options"))


def unknown_codes(variables: DataFrame, codes: list[str]) -> list[str]:
    """Those of ``codes`` that the codebook lacks, for a warning."""
    known = {r["code"] for r in variables.where(F.col("code").isin(codes)).select("code").collect()}
    return [c for c in codes if c not in known]


def sample_targets(variables: DataFrame, values: DataFrame, n: int, seed: int, exclude_sections: tuple[str, ...] = (), drop: DataFrame | None = None, representatives: DataFrame | None = None) -> DataFrame:
    """(code, section): n targets by hash out of the variables with labels. Variables in ``drop`` (code) go; ``representatives`` (code, section) join in."""
    own = target_rows(variables, values).where(~F.col("section").isin(["EXCLUDED", *exclude_sections])).select("code", "section")
    if drop is not None:
        own = own.join(drop.select("code").distinct(), "code", "left_anti")
    if representatives is not None:
        own = own.unionByName(representatives.select("code", "section"))
    return own.orderBy(order_key(seed, F.col("code")), "code").limit(n)
