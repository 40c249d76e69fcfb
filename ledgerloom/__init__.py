"""Analytics over ledgers of LLM requests, as Spark DataFrame operators."""
