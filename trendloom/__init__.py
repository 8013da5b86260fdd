"""Type-conditioned trend analytics over labelled time series and gridded fields, as Spark jobs."""
