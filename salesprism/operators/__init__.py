"""DataFrame operators: cleaning, market metrics and the datasets behind the charts."""
