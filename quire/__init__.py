"""quire: vector-neighbour and page analytics as DataFrame-in, DataFrame-out functions on Spark SQL."""
