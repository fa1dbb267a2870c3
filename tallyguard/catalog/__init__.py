"""All registered queries; importing the modules fills the registry."""

from tallyguard.catalog import aggregates, features, graphs, models, scoring, sources, streams, windows  # noqa: F401
from tallyguard.catalog.base import QUERIES, SQL  # noqa: F401
