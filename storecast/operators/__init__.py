"""The work on panels: calendars, features, folds, baselines, errors, segments, monitoring."""
