"""Registered queries, each with the SQL that must give the same rows."""

from courtside.checks import evaluation, extended, files, ingest, models, scoring, windows

ALL_CHECKS = (windows, ingest, evaluation, scoring, models, files, extended)
