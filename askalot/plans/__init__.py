"""Registered queries of the survey operators, and SQL for each."""

from . import codebook_queries, part_queries, respondent_queries, survey_queries, testset_queries, variation_queries

#: Modules with QUERIES and oracles().
ALL = (survey_queries, testset_queries, variation_queries, respondent_queries, codebook_queries, part_queries)
