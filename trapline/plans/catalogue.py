"""Every registered query; importing the modules fills the registry."""

from trapline.plans import (diagnostics, draws, formulas, log, shapes, space)  # noqa: F401
from trapline.plans.registry import ORACLES, QUERIES  # noqa: F401
