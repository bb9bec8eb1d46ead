"""Queries over the provided tables and their SQL. Keys start with the ids of the operators they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import documents, html, ingest, measured, options, prediction, scalars, scans, second_pass, shortlists, sources, tables

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (scalars, tables, prediction, second_pass, measured, shortlists, ingest, documents, scans, sources, options, html):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every open seat of the target term: the likeliest holders, and the share of somebody new."""
    return prediction.predict(spark, sf_dir)
