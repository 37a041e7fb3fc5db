"""tallyfold: payment-fraud analytics as lazy Spark DataFrame operators."""
