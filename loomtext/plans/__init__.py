"""Named queries over the plain tables, with the SQL that gives the same rows."""

from loomtext.plans import annotation, audits, augmentation, evaluation, files
from loomtext.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "annotation", "audits", "augmentation", "evaluation", "files"]
