"""Analytics over genomic intervals measured in single cells, written for Spark."""
