"""Physical-plan helpers: staged tables, exact order statistics, size-checked joins."""
