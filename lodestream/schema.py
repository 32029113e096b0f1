"""Schemas of the record stores. ``_pos`` is arrival order, ``_raw`` keeps fields that are unknown."""

from __future__ import annotations

LOG = "_pos bigint, command string, params array<string>, timestamp double, success boolean, return_code bigint, duration_ms double, _raw variant"
ITEM = "id bigint, name string, description string"
KEY_VALUE = "key string, value string"
MEMORY = "key string, value variant"
PLUGIN = "name string, desc string, version string"

#: Rows that listing, loading and writing keep.
DEFAULT_LIMIT = 20
KEPT_IN_MEMORY = 10_000
KEPT_ON_DISK = 1_000
