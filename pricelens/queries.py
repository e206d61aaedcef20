"""All registered queries; importing the modules registers them."""

from .functions import grammar, history, parsing, proofs, scalars, text, variants  # noqa: F401
from .operators import catalog, confirmations, fair_value, joins, offers, ratios, robust, selection, signals, titles, valuation  # noqa: F401
from .plans import economics, providers  # noqa: F401
from .sources import adapters, audits, pages, sale_source, state  # noqa: F401
from .registry import COVERS, QUERIES, SQL  # noqa: F401
from .streaming import alerts, budgets, commits, incremental, twins  # noqa: F401
