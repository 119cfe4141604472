"""Analytics over multi-agent time series and vector spaces, as Spark DataFrame programs."""
