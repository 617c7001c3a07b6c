"""DataFrame operators: sliding windows, rules, alert folding, triage, rollups, baselines."""
