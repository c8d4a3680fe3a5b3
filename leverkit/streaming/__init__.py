"""Incremental ingest of landed files.

The analyses are batch computations; nothing here is a new operator.  What
streaming adds is the robust way to run the tolerant bulk ingest (files of
play-by-play arriving per date or per game) incrementally: each run picks
up only new files, bad records go to a quarantine table, and progress lives
in a checkpoint in the cluster's shared folder, so a lost executor or a
restarted job neither loses nor duplicates rows.
"""
from .ingest import ingest_landed_files  # noqa: F401
