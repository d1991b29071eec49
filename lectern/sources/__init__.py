"""Readers: JSON lines, text, CSV, manifests, result folders, releases, PDB atoms, and adapters for public sources."""

from lectern.sources.files import (  # noqa: F401
    cases_for_track,
    leaderboard_rows,
    model_list,
    prior_run_counts,
    read_cases,
    read_csv,
    read_export,
    read_jsonl,
    read_manifest,
    read_pdb_atoms,
    read_predictions,
    read_release,
    read_results,
    read_text,
    read_training,
    source_by_name,
)
