"""DataFrame-to-DataFrame steps: cleaning, facts, cohorts, forecasts, scores."""
