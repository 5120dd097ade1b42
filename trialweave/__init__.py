"""Target-trial analytics on Spark DataFrames: cohort rules, as-of and interval
lookups, hourly panels, clone-censor-weight and weighted survival contrasts."""
