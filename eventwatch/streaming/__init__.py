"""The same rules and folds under Structured Streaming."""
