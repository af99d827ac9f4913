"""Named queries over the stand-in views, each with the SQL it is checked against."""

from registry import checks, diversity, evaluation, geo, joins, model, scoring, sources, transforms  # noqa: F401
from registry.base import REGISTRY  # noqa: F401
