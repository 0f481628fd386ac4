"""Registered queries of the retrieval engine and their SQL."""

from __future__ import annotations

from gritstone.jobs import answer, curate, evaluate, experiment, ground, headings, ingest, retrieve

QUERIES = retrieve.QUERIES | evaluate.QUERIES | answer.QUERIES | ingest.QUERIES | curate.QUERIES | ground.QUERIES | experiment.QUERIES | headings.QUERIES
SQL = retrieve.SQL | evaluate.SQL | answer.SQL | ingest.SQL | curate.SQL | ground.SQL | experiment.SQL | headings.SQL
