"""Analytics over captured web pages, written as Spark DataFrame transformations."""
