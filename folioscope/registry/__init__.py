"""Every operator as a named query over the given tables, with its SQL twin where there is one."""

from folioscope.registry import analytics, catalog, derivations, streams, tables  # noqa: F401
from folioscope.registry.base import ORACLES, QUERIES  # noqa: F401
