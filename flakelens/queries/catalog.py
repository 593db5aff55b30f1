"""All registered queries: name -> (Spark query, SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ("scalars", "loglines", "evidence", "code", "patching", "loop", "storage")

CATALOG = {}
for _name in MODULES:
    CATALOG.update(importlib.import_module(f"{__package__}.{_name}").QUERIES)
