"""Every registered query of the engine, with equivalent SQL where SQL can express it."""

from strataloom.plans import graphs, joins, paths, retrieval, services, texts, upkeep, vectors  # noqa: F401
from strataloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
