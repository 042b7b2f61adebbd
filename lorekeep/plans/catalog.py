"""All queries of the engine proper, by name."""

from lorekeep.plans import context, knowledge, lifecycle, memory, reading, writing

QUERIES = {**memory.QUERIES, **knowledge.QUERIES, **context.QUERIES, **lifecycle.QUERIES, **reading.QUERIES, **writing.QUERIES}
ORACLES = {**memory.ORACLES, **knowledge.ORACLES, **context.ORACLES, **lifecycle.ORACLES, **reading.ORACLES, **writing.ORACLES}
