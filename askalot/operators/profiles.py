"""Stratified, seeded, nested respondent profiles."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import order_key
from .decode import is_missing


@dataclass(frozen=True)
class ProfileConfig:
    n_sections: int = 3
    m_features: int = 2
    seed: int = 42

    @property
    def profile_type(self) -> str:
        return f"s{self.n_sections}m{self.m_features}"


def feature_pool(variables: DataFrame, excluded: list[str] = (), always: list[str] = ()) -> DataFrame:
    """Variables that may be drawn."""
    return variables.where(~F.col("code").isin([*excluded, *always, ""]))


def draw_sections(pool: DataFrame, respondents: DataFrame, config: ProfileConfig) -> DataFrame:
    """(respondent_id, section, section_pos): the first n sections by hash. Ranks ignore n, so smaller draws nest in larger ones."""
    sections = pool.select("section", "section_pos").distinct()
    rank = F.row_number().over(Window.partitionBy("respondent_id").orderBy(order_key(config.seed, F.col("respondent_id"), "S", F.col("section")), "section"))
    return respondents.select("respondent_id").crossJoin(F.broadcast(sections)).withColumn("__r", rank).where(F.col("__r") <= config.n_sections).drop("__r")


def draw_features(decoded: DataFrame, pool: DataFrame, config: ProfileConfig) -> DataFrame:
    """(respondent_id, section, section_pos, code, raw, label, pick): the first m valid answers of each section by hash."""
    valid = decoded.where(~is_missing(F.col("label"))).join(pool.select("section", "section_pos", "code"), "code")
    key = order_key(config.seed, F.col("respondent_id"), F.col("section"), F.col("code"))
    rank = F.row_number().over(Window.partitionBy("respondent_id", "section").orderBy(key, "code"))
    return valid.withColumn("pick", rank).where(F.col("pick") <= config.m_features).select("respondent_id", "section", "section_pos", "code", "raw", "label", "pick")


def profiles(decoded: DataFrame, pool: DataFrame, respondents: DataFrame, config: ProfileConfig) -> DataFrame:
    """The drawn features of the drawn sections, a row for each."""
    drawn = draw_sections(pool, respondents, config)
    return draw_features(decoded, pool, config).join(drawn.select("respondent_id", "section"), ["respondent_id", "section"])


def shortfall(decoded: DataFrame, pool: DataFrame, config: ProfileConfig) -> DataFrame:
    """(respondent_id, section, n_valid): sections with fewer valid answers than m, those without any left out."""
    valid = decoded.where(~is_missing(F.col("label"))).join(pool.select("section", "code"), "code")
    return valid.groupBy("respondent_id", "section").agg(F.count(F.lit(1)).alias("n_valid")).where(F.col("n_valid") < config.m_features)


def sample_respondents(respondents: DataFrame, n: int, seed: int) -> DataFrame:
    """min(n, N) distinct ids that aren't null, by hash."""
    ids = respondents.select("respondent_id").where("respondent_id is not null").distinct()
    return ids.orderBy(order_key(seed, F.col("respondent_id")), "respondent_id").limit(n)
