"""Analytics over sampled signals and sparse event tables, expressed as Spark DataFrame operators."""
