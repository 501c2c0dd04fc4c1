"""Analysis of timed, pitched, syllable-level song charts on Spark."""
