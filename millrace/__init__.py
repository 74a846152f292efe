"""Stream-processing analytics on Spark: operators are pure ``DataFrame -> DataFrame`` functions."""
