"""Models fitted on the sales fact: small parameters on the driver, every row scored in Spark."""
