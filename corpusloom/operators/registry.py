"""All queries of the dialog-corpus operators, and their SQL."""

from . import curation, dialog, files, generation, geometry, linkage, miner, mining, profile, regenerate, texts, training, turn_features  # noqa: F401

QUERIES = dialog.QUERIES
ORACLE_SQL = dialog.ORACLE_SQL
