"""Models, the forecaster, and the jobs to submit."""
