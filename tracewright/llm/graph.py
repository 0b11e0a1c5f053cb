"""The library's graph operators and lookups, with lineage cut by tables in the shared folder."""

from __future__ import annotations

from functools import partial

from tracewright.llm.common import stored
from tracewright.operators import graph, lookup

components = partial(graph.rounds, keep=stored)
merged = partial(graph.merged, keep=stored)
looked_up = partial(lookup.looked_up, keep=stored)
