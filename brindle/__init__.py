"""brindle: a Spark-first engine for multi-source product, price and corpus data."""
