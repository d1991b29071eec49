"""Writers: JSON lines, CSV, splits, leaderboards, reports, templates, schemas, archives."""
