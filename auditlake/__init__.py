"""Analytics over tamper-evident logs of automated agents, as DataFrame, SQL and Structured Streaming jobs."""
