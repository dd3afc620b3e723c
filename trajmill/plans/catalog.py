"""All registered queries and their SQL."""

from trajmill.plans import corpus, evaluation, files, streams, tokens  # noqa: F401  (registration)
from trajmill.plans.registry import ORACLES, QUERIES  # noqa: F401
