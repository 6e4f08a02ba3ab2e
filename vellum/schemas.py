"""Schemas of stored lines, as DDL strings Spark readers accept."""

from __future__ import annotations

RUN_EVENT = "seq bigint, type string, run_id string, kind string, project_slug string, message string"
