"""Analytics operators for Spark DataFrames: league tables, clustering, queues, routes, numerals, trees."""
